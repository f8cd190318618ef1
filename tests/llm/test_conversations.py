"""Conversations and urls against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from ridgeline.llm import prefix_trie, repair, turns, url_filter

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


@pytest.fixture
def spread(spark):
    """Small partitions stay apart, so that keys really are cut into blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(seed: int, convs=range(-3, 210, 7), most: int = 9) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["", "Hi.", "Well", "So?\n", "é\u3000.", " \t", "Hi. ", "one. two", "long " * 300]
    rows = []
    for c in [*convs, None, 0, 100, 200]:
        for t in range(rnd.randrange(most)):
            rows.append((c, rnd.choice([None, t, t, t, t + 5, 0]), rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), rnd.choice([*words, None]), 1))
    rows += rows[:6] + [(5, -(2**63), "user", "far.", 0), (5, 2**63 - 1, "assistant", "apart.", 0)]
    return rows


def by_turn(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role, text))
    return {c: [r[2:] for r in sorted(v)] for c, v in out.items()}


def trie_by_loops(rows):
    own = by_turn((c, t, r or "", x or "") for c, t, r, x, _ in rows if c is not None)
    paths = {}
    for c in own:
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(node))))
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), leaves, saved, sha(ends)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_trie_against_loops(spread, parts):
    rows = awkward(1) + [(c, t, "user", f"same {t}.", 1) for c in (300, 301, 302, 303) for t in range(12)] + [(7, t, "user", "on", 1) for t in range(400)]
    frame = spread.createDataFrame(rows, SCHEMA).repartition(parts)
    ids, each = prefix_trie.with_shared_heads(prefix_trie.turns_in_order(frame), 100, prefix_trie.F.crc32(prefix_trie.F.col("conv_id").cast("string")) % 6)
    got = prefix_trie.prefix_trie(ids, each)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == trie_by_loops(rows)


def test_trie_of_nothing_and_of_many_equal(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty.select("conv_id"), prefix_trie.turns_in_order(empty).withColumnRenamed("pos", "depth")).count() == 0
    same = spark.createDataFrame([(c, 0, "user", "x", 1) for c in range(-40, 90)], SCHEMA)
    ids = same.select("conv_id").distinct()
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(ids, prefix_trie.turns_in_order(same).withColumnRenamed("pos", "depth")).collect()}
    assert len(got) == 2 and got[1]["n_convs"] == 130 and got[1]["saved_tokens"] == 129 and got[0]["n_leaves"] == 1
    assert got[1]["ends_sha256"] == sha(",".join(map(str, range(-40, 90)))) and got[0]["ends_sha256"] == sha("")


def test_a_long_conversation_is_numbered_in_blocks(spread):
    rows = [(1 if i % 3 else 2, i % 50, "user", str(i), 1) for i in range(3000)]
    got = turns.numbered(spread.createDataFrame(rows, SCHEMA).repartition(6), "conv_id", [prefix_trie.F.col("turn"), prefix_trie.F.col("text")])
    assert got.where("conv_id = 1").select("blk").distinct().count() > 1
    for c in (1, 2):
        want = sorted((t, x) for k, t, _, x, _ in rows if k == c)
        assert [(r["turn"], r["text"]) for r in got.where(f"conv_id = {c}").orderBy("pos").collect()] == want
        assert [r["pos"] for r in got.where(f"conv_id = {c}").orderBy("pos").collect()] == list(range(1, len(want) + 1))


def repair_by_loops(rows):
    hurt = []
    for c, t, role, text, _ in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after, out = by_turn(hurt), {}
    for c in {r[0] for r in rows}:
        conv = after.get(c, [])
        turn = [t for k, t, _, _ in hurt if k == c and t is not None]
        seen, kinds = set(), []
        for role, text in conv:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserted):
            """(cost, audit) from here to the end; all ways are tried."""
            ways = []
            if i == len(conv) and state in ("", "a"):
                ways.append((0, ""))
            grammar = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if inserted < 3:
                ways += [(2 + w[0], "I" + w[1]) for r in "ua" if r in grammar for w in [best(i, r, inserted + 1)] if w]
            if i < len(conv):
                w = best(i + 1, state, 0)
                ways += [(3 + w[0], "D" + w[1])] if w else []
                if kinds[i] in ("", "t"):
                    more = kinds[i] == "t"
                    for letter, r, price in [("K", conv[i][0][:1], 0), ("R", "u", 2), ("R", "a", 2)]:
                        if r and r in grammar and (w := best(i + 1, r, 0)):
                            ways.append((price + more + w[0], letter + w[1]))
            return min(ways, default=None)

        cost, audit = best(0, "", 0)
        state, i, lines = "", 0, []
        for e in audit:
            role = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{role}:")
                state = role[0]
                continue
            if e != "D":
                role = conv[i][0] if e == "K" else role
                lines.append(f"{role}:{conv[i][1]}")
                state = role[0]
            i += 1
        initials = [r[:1] for r, _ in conv]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = min(max(turn) - min(turn) + 1 - len(set(turn)), 2**63 - 1) if turn else 0
        out[c] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha("\n".join(lines)))
    return out


@pytest.mark.parametrize("block", [repair.BLOCK, 3, 1])
def test_repair_against_all_ways(spread, block):
    rows = awkward(3, range(0, 120), 12)
    frame = spread.createDataFrame(rows, SCHEMA).repartition(4)
    got = repair.structure_repair(repair.damaged(frame), frame, block)
    found = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == len(found) and found == repair_by_loops(rows)


def test_repair_of_nothing_and_of_a_long_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.structure_repair(repair.damaged(empty), empty).count() == 0
    rows = [(1, t, ("user", "assistant")[(t + t // 97) % 2], f"turn {t}{'.' if t % 13 else ''}", 1) for t in range(5000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    one, cut = (repair.structure_repair(frame, frame, b).collect() for b in (10_000, 700))
    assert one == cut and len(one) == 1


def test_prefers_the_least_audit():
    assert repair.cheapest([], 0, True) == {0: (0, "")}
    assert repair.cheapest([("a", repair.FINE)], 0, True) == {3: (2, "IK")}
    assert repair.cheapest([("s", repair.FINE)], 0, True) == {0: (3, "D")}


URLS = [
    (1, "https://A.example.COM/en/1"), (2, "https://www.example.com/en/2?x"), (3, "http://foo.net/es/#t"), (4, "http://foo.net/de"), (5, "ftp://x.com"), (6, None), (7, "no scheme"), (8, "a://b.net?q=/fr/"),
    (9, "http://example.com/en/" + "x" * 5000), (10, "http://notexample.com/en/"), (11, "http://net/fr/a://b"), (12, "http://ÄB.net/fr/"), (None, "http://foo.net/fr/"), (1, "https://A.example.COM/en/1"), (13, "http://u@bad.org:80/"), (14, ""),
]


def test_rules_by_loops(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_filter.url_filter(pages, none).select("page_id", "host", "path", "rule", "verdict").collect()
    want = []
    for i, u in URLS:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.host + r.path), default=None)
        want.append((i, host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert url_filter.url_filter(pages.limit(0), none).count() == 0


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows, marks = [], []

    def add(host, bad, good, unknown=1):
        for k in range(bad + good + unknown):
            rows.append((len(rows), f"http://{host}/{k}"))
            if k < bad + good:
                marks.append((len(rows) - 1, k < bad))

    for k in range(20):
        add(f"h{k}.spam.org", 9, 1)
        add(f"h{k}.fine{k}.org", 0, 10)
    add("new.spam.org", 0, 0)
    add("new.fine1.org", 0, 0)
    marks += [(marks[0][0], None), (10**6, True), (None, True)]

    def judged():
        pages = spark.createDataFrame(rows, "page_id long, url string")
        return {r["host"]: r for r in url_filter.url_filter(pages, spark.createDataFrame(marks, "page_id long, bad boolean"), rules=()).collect()}

    got = judged()
    said = {h: r["verdict"] for h, r in got.items()}
    assert said["h3.spam.org"] == said["new.spam.org"] == "block"
    assert said["h3.fine3.org"] == said["new.fine1.org"] == "allow"
    assert got["new.spam.org"]["n_labelled"] == 0 and got["h3.spam.org"]["bad_bound"] > got["new.spam.org"]["bad_bound"]
    # a host with many labels follows its own pages, and one that differs so much makes its siblings say less of unknown ones
    add("good.spam.org", 0, 40)
    after = judged()
    assert after["good.spam.org"]["verdict"] == "allow" and after["h3.spam.org"]["verdict"] == "block" and after["new.spam.org"]["bad_bound"] < got["new.spam.org"]["bad_bound"]


def test_one_bad_page_is_not_enough_where_hosts_are_alike(spark):
    shares = {f"h{k}.d{k % 7}.org": (1 + k % 3, 18 - k % 3) for k in range(400)} | {"once.d1.org": (1, 0), "always.d1.org": (60, 0)}
    counts = spark.createDataFrame([(h, bad + good, bad) for h, (bad, good) in shares.items()], "host string, n long, bad long")
    got = {r["host"]: r["low"] for r in url_filter.reputations(counts).select("host", url_filter.lower_bound().alias("low")).collect()}
    assert got["once.d1.org"] < url_filter.MOST_BAD < got["always.d1.org"] and max(v for h, v in got.items() if h[0] == "h") < url_filter.MOST_BAD


def test_domains_and_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "x.y.com", "com", "", "10.0.0.1:80", "u@x.y.com.", "[::1]:8")], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_levels(hosts).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "com": ("com", "com"), "": ("", ""), "10.0.0.1:80": ("10.0.0.1",) * 2, "u@x.y.com.": ("y.com", "com"), "[::1]:8": ("[::1]",) * 2}


def test_no_python_for_urls_and_partial_sums_by_host(spark):
    pages = spark.createDataFrame([(i, u) for i, u in URLS], "page_id long, url string").selectExpr("page_id", "url")
    labels = spark.createDataFrame([(1, 0, None)], "doc_id long, quality int, toxic int")
    plan = url_filter.url_filter(pages, url_filter.label_outcomes(labels))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Cartesian|NestedLoop", plan)
