"""Exact, line and near deduplication against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import line_dedup as lines
from ridgeline.llm import near_dedup as near
from ridgeline.llm.components import components
from ridgeline.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, id int, key int, _text string"


def docs_of(spark, texts, ids=None):
    """With extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1, 2, "y") for i, t in enumerate(texts)], SCHEMA)


def fold(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def test_exact(spark):
    texts = [None, "", "Ab", "aB", "É", "é", "x" * 200_000, "x" * 200_000, "one"] + ["hot"] * 300
    got = {r["doc_id"]: r for r in exact_dedup(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if fold(u) == fold(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i == max(same))
        assert r["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()


def test_exact_empty_and_null_ids(spark):
    assert exact_dedup(docs_of(spark, [])).count() == 0
    assert exact_dedup(docs_of(spark, ["a", "b"], [None, None])).count() == 2


def test_exact_repeated_rows(spark):
    texts, ids = ["same", "Same", "same", "other", "same", "none", "none"], [3, 3, 1, 3, None, None, None]
    got = exact_dedup(docs_of(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 3, 4, False), (1, 3, 4, False), (3, 3, 1, True), (3, 3, 4, False), (3, 3, 4, True),
    ]


def test_exact_where_digests_name_several_texts(spark):
    r = random.Random(9)
    texts, ids = [r.choice(["a", "A", "b", "c" * 50, "", None, "d"]) for _ in range(120)], [r.choice([None, *range(40)]) for _ in range(120)]
    docs = docs_of(spark, texts, ids)
    key = lambda r: (r["doc_id"] is None, *(str(x) for x in r))
    plain, weak = (sorted(exact_dedup(docs, salts=3, **more).collect(), key=key) for more in ({}, {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 1)}))
    assert [r[:3] + r[4:] for r in plain] == [r[:3] + r[4:] for r in weak]
    for rows in (plain, weak):
        kept = [(r["text_sha256"], r["doc_id"]) for r in rows if r["kept"]]
        assert len(kept) == len({t for t, _ in kept}) == len({fold(t) for t in texts}) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_hot_text_without_ids(spark):
    got = exact_dedup(docs_of(spark, ["hot"] * 500 + ["cold"], [None] * 501)).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == sorted([(500, False)] * 499 + [(500, True), (1, True)])


def test_exact_combines_before_it_shuffles_texts(spark):
    """Without broadcasts, whole texts leave a partition as keys of a partial aggregate, dealt by salt, and nowhere else by digest alone."""
    from ridgeline.llm import exact_dedup as module

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs_of(spark, ["a", "b", "A"] * 20)
        rows = module._rows(docs, "doc_id", "text").withColumn("_digest", module.sha256(F.col("_text")))
        plan = module.groups(rows)._jdf.queryExecution().executedPlan().toString()
        last = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    deals = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(deals) == 2 and all("Aggregate" in lines[i + 1] and "partial_" in lines[i + 1] for i in deals)
    assert "_salt" in lines[deals[1]].split("),")[0] and "_text" in lines[deals[0]]
    assert "_text#" not in last  # documents meet their groups without texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def mutated(r, s, most):
    s = list(s)
    for _ in range(r.randint(0, most)):
        i, k = r.randrange(len(s) + 1), r.random()
        if k < 0.33:
            s.insert(i, r.choice("ab é"))
        elif s and k < 0.66:
            del s[min(i, len(s) - 1)]
        elif s:
            s[min(i, len(s) - 1)] = r.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2])
def test_banded_distance(spark, tau):
    r = random.Random(tau)
    pairs = []
    while len(pairs) < 200:
        a = "".join(r.choice("abé") for _ in range(r.randint(tau + 1, 40)))
        b = mutated(r, a, 4)
        a, b = max(a, b, key=len), min(a, b, key=len)
        if len(a) - len(b) <= tau < len(b):
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.withColumn("d", lines.banded_distance(F.col("a"), F.col("b"), tau)).collect():
        true = distance(row["a"], row["b"])
        assert row["d"] == true if true <= tau else row["d"] > tau


@pytest.mark.parametrize("hot", [lines.HOT, 1])
def test_line_verdicts_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)  # 1: every shared segment is joined with the bound on characters
    r = random.Random(3)
    base = ["".join(r.choice("ab cé") for _ in range(r.randint(18, 34))) for _ in range(12)]
    texts = ["\n".join(mutated(r, r.choice(base), 2) for _ in range(r.randint(0, 4))) for _ in range(25)] + [None, "", "  \n ", "short\nshort", "short"]
    got = {(x["id"], x["at"]): x for x in lines.line_verdicts(docs_of(spark, texts)).collect()}
    all_ = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    assert set(got) == {(i, n) for i, n, _ in all_}
    first = {}
    for i, n, line in all_:
        first.setdefault(line, (i, n))
    similar = {a: [b for b in first if b != a and max(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= lines.TAU and distance(a, b) <= lines.TAU] for a in first}
    for i, n, line in all_:
        v = got[i, n]
        assert v["copy"] == (first[line] != (i, n))
        assert v["near"] == any(first[b] < first[line] for b in similar[line])
        assert v["links"] == len(similar[line])


def test_lines_go_and_documents_stay(spark):
    own = [f"this is line number {i} of its own document {'abcdefgh'[i] * 20}" for i in range(4)]
    licence = "Licensed under the terms that follow below."
    texts = [f"{own[0]}\n{licence}", f"{own[1]}\n{licence.replace('terms', 'terns')}\n\nend of it {'z' * 40}", own[0], None, f"{own[0]}\n{licence}"]
    out = {r["doc_id"]: r for r in lines.without_repeated_lines(docs_of(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == f"{own[1]}\n\nend of it {'z' * 40}"
    assert out[2]["text"] == "" and out[3]["text"] is None  # a part of a longer document goes
    assert out[4]["text"] == texts[0]  # a copy as a whole is left alone
    assert lines.without_repeated_lines(docs_of(spark, [])).count() == 0
    report = {r["doc_id"]: r for r in lines.line_dedup(docs_of(spark, texts)).collect()}
    assert (report[1]["n_near"], report[1]["dropped"], report[4]["whole_copy"], report[3]["n_lines"]) == (1, "1", True, 0)


def test_rows_without_or_with_repeated_ids_lose_lines_of_their_own(spark):
    filler = [f"filler {i} of one document alone {'abcdefgh'[i] * 60}" for i in range(4)]
    texts = [f"{c}\n{f}\nthe passage that they all share" for c, f in zip(["what only the first has to say", "another matter altogether", "third", "and a fourth"], filler)]
    docs = docs_of(spark, texts, [None, None, 7, 7])
    out = sorted(r["text"] for r in lines.without_repeated_lines(docs).collect())
    shared = [t for t in out if t.endswith("share")]
    assert len(out) == 4 and len(shared) == 1  # one of those without an id keeps it, they count as the smallest
    assert shared[0] in texts[:2] and set(out) == {t if t in shared else t.rsplit("\n", 1)[0] for t in texts}
    report = lines.line_dedup(docs).collect()
    assert sorted((r["n_lines"], r["n_dropped"]) for r in report) == [(3, 0), (3, 1), (3, 1), (3, 1)]
    # at different positions: a line number that goes in one row stays in the other
    swapped = ["shared line of both of them\nonly here, number one " + "q" * 60, "only here, number two " + "z" * 60 + "\nshared line of both of them"]
    left = {r["text"] for r in lines.without_repeated_lines(docs_of(spark, swapped, [None, None])).collect()}
    assert left in ({swapped[0], swapped[1].split("\n")[0]}, {swapped[1], swapped[0].split("\n")[1]})


def test_only_proved_copies_keep_repeated_lines(spark):
    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(10))
    one, two, passage = [line() for _ in range(12)], [line() for _ in range(12)], [line() for _ in range(6)]
    own = [[line() for _ in range(4)] for _ in range(4)]
    parts = [
        one, two, passage + own[0],
        passage + own[1],  # 60 % of it is a passage of another
        one[:6] + two[:6],  # all of it repeated, but of two documents
        one[:11] + own[2][:1],  # near copies as a whole: windows 106 of 116 + 116 - 106
        one[::-1][:10] + own[3][:1],  # the same lines, in another order
        two,
    ]
    out = {x["doc_id"]: x["text"] for x in lines.without_repeated_lines(docs_of(spark, ["\n".join(p) for p in parts])).collect()}
    left = [out[i].split("\n") if out[i] else [] for i in range(len(parts))]
    assert left == [one, two, parts[2], own[1], [], parts[5], own[3][:1], two]
    report = {x["doc_id"]: x for x in lines.line_dedup(docs_of(spark, ["\n".join(p) for p in parts])).collect()}
    assert [report[i]["n_dropped"] for i in range(len(parts))] == [0, 0, 0, 6, 12, 0, 10, 0]
    assert [report[i]["whole_copy"] for i in range(len(parts))] == [False] * 5 + [True, False, True]


def test_parts_and_reordered_documents_lose_their_repeats(spark):
    r = random.Random(6)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(9))
    lines40, turned = [line() for _ in range(40)], [line() for _ in range(6)]
    texts = ["\n".join(lines40), "\n".join(lines40[5:10]), lines40[7], "\n".join(turned), "\n".join(turned[::-1]), "\n".join(turned), "\n\n".join(turned), "only", "only"]
    got = {r["doc_id"]: r for r in lines.line_dedup(docs_of(spark, texts)).collect()}
    assert [got[i]["n_dropped"] for i in range(9)] == [0, 5, 1, 0, 6, 0, 0, 0, 0]
    assert [got[i]["whole_copy"] for i in range(9)] == [False, False, False, False, False, True, True, False, True]


def test_repeated_rows_count_once(spark):
    texts, ids = ["a line that is long enough\nand another line of it"] * 3 + ["and another line of it\nown words stand here alone"] * 2, [5, 5, None, 7, 7]
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_copies"], r["n_dropped"]) for r in lines.line_dedup(docs_of(spark, texts, ids)).collect())
    assert got == [(0, 2, 0, 0), (5, 2, 2, 0), (5, 2, 2, 0), (7, 2, 1, 1), (7, 2, 1, 1)]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for u, v in edges:
        root[find(u)] = find(v)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    members = {}
    for u, v in edges:
        if u != v:
            members.setdefault(find(u), set()).update((u, v))
    assert got == {v: min(m) for m in members.values() for v in m}


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


WORDS = ["".join(random.Random(i).choice("abcdefghij") for _ in range(5)) for i in range(400)]


def test_near_against_brute_force(spark):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(r, r.randint(60, 200))
        texts.append(" ".join(base))
        for changes in (1, 2, 12):
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(len(copy))] = "changed"
            texts.append("  ".join(copy).upper())
    texts += [None, "", " ", "two words", "Two  WORDS", "two words more"] + [texts[0]] * 30
    got = {x["doc_id"]: x for x in near.near_dedup(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append(frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]))
    for i in range(len(texts)):
        for j in range(i):
            share = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            if share >= 0.8:
                assert got[i]["class_id"] == got[j]["class_id"], (i, j, share)
            if share < 0.2:
                assert got[i]["class_id"] != got[j]["class_id"]
    for x in got.values():
        members = [k for k, y in got.items() if y["class_id"] == x["class_id"]]
        assert x["class_id"] == max(members) and x["class_size"] == len(members) and x["kept"] == (x["doc_id"] == max(members))


def test_near_links_need_one_shared_sketch(spark, monkeypatch):
    """Two pairs across first-round components that are alike and share few sketches."""
    r = random.Random(5)
    found = []
    while len(found) < 2:
        # four of five windows, as of texts of 8 and 9 words: the chance of few shared sketches is largest there
        base = prose(r, 9)
        sketches = [near.order_sketches(near.word_hashes(" ".join(t), near._Words())) for t in (base, base[:8])]
        agree = int((sketches[0] == sketches[1]).sum())
        if 0 < agree < 6:
            found.append((" ".join(base), " ".join(base[:8])))
    a, b = (near.word_hashes(t, near._Words()) for t in found[0])
    assert near.similarity(a, b) == pytest.approx(0.8)
    # no comparison with leaders: all pairs are left to the second round
    real = near.materialise
    monkeypatch.setattr(near, "materialise", lambda df, label: real(df.limit(0) if label == "pairs" else df, label))
    got = {x["doc_id"]: x["class_id"] for x in near.near_dedup(docs_of(spark, [t for pair in found for t in pair])).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3}


def test_near_edge_cases(spark):
    assert near.near_dedup(docs_of(spark, [])).count() == 0
    assert near.keep_one_of_each(docs_of(spark, [])).count() == 0
    rows = near.near_dedup(docs_of(spark, ["a", "a", "b"], [None, 1, 1])).collect()
    got = sorted((r["doc_id"] or 0, r["class_id"], r["class_size"], r["kept"]) for r in rows)
    assert got == [(0, 1, 2, False), (1, 1, 1, True), (1, 1, 2, True)]
    assert {r["doc_id"] for r in near.keep_one_of_each(docs_of(spark, ["same text", "same  text", None])).collect()} == {1, 2}


def test_near_rows_without_or_with_repeated_ids(spark):
    """Whole texts tell: no id stands for several texts, and of repeated rows one stays."""
    r = random.Random(2)
    a, b, c, d, long = (prose(r, n) for n in (60, 70, 80, 50, 20_000))
    near_b, near_long = b[:30] + ["changed"] + b[31:], long[:9000] + ["changed"] + long[9001:]
    texts = [" ".join(t) for t in (a, a, b, near_b, c, c, d, d, long, near_long)] + [None, ""]
    ids = [9, 5, 5, 5, None, None, 4, 4, 1, 2, None, 3]
    rows = near.near_dedup(docs_of(spark, texts, ids)).collect()
    assert len(rows) == len(texts) and sum(x["kept"] for x in rows) == 6
    kept = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["class_id"] if x["class_id"] is not None else -1, x["class_size"]) for x in rows if x["kept"])
    assert kept == [(-1, -1, 2), (2, 2, 2), (3, 3, 2), (4, 4, 2), (5, 5, 2), (9, 9, 2)]
    out = near.keep_one_of_each(docs_of(spark, texts, ids))
    assert out.columns == docs_of(spark, []).columns
    left = [(x["doc_id"], x["text"]) for x in out.collect()]
    assert len(left) == 6 and (5, texts[2]) in left or (5, texts[3]) in left
    assert {t for _, t in left} - {texts[2], texts[3]} == {texts[0], texts[4], texts[6], texts[9], ""}


def test_rare_window_pairs_leave_no_link_out(spark):
    """All pairs of one original's copies, of which many are out of reach of each other and of the original, and passages, against brute force."""
    import numpy as np

    r = random.Random(12)
    base = prose(r, 150)
    texts = [base]
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice((1, 2, 3, 3, 4, 5, 6, 9))):
            copy[r.randrange(len(copy))] = f"new{r.randrange(40)}"
        texts.append(copy[r.choice((0, 0, 0, 15)) :])
    texts += [base[:40] + prose(r, n) for n in (30, 60)] + [prose(r, n) for n in (5, 6, 150)]
    sequences = [np.frombuffer(near.word_hashes(" ".join(t), near._Words()).tobytes(), np.uint32) for t in texts]
    windows = [near.labelled(near.shingles(w)).view(np.int64) for w in sequences]
    rows = [(i, r.choice((i, 1000)), len(w), w.tolist(), near.parities(w.view(np.uint64)).tolist()) for i, w in enumerate(windows)]
    want = set()
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(windows[i], windows[j]))
            if rows[i][1] != rows[j][1] and both >= 0.8 * (rows[i][2] + rows[j][2] - both):
                want.add((i, j))
    got = {(x["u"], x["v"]) for x in near.rare_window_pairs(spark.createDataFrame(rows, "node long, component long, n int, windows array<long>, bits array<long>"), 0.8).collect()}
    assert len(want) > 200 and want <= got
    assert all(rows[u][1] != rows[v][1] for u, v in got) and len(got) < 3 * len(want)


def test_order_matters_to_similarity():
    import numpy as np

    a = np.arange(400, dtype=np.uint32)
    assert near.similarity(a, a) == 1 and near.similarity(a, np.concatenate([a[200:], a[:200]])) == 0
    assert near.similarity(a, np.delete(a, 100)) == pytest.approx(391 / (396 + 395 - 391))


def test_long_texts_with_parts_swapped_are_told_apart_quickly(monkeypatch):
    import time

    import numpy as np

    r = np.random.default_rng(4)
    a = r.integers(0, 1 << 60, 20_000).astype(np.uint64)
    begun = time.perf_counter()
    assert near.similarity(a, np.r_[a[10_000:], a[:10_000]]) == 0.0 and time.perf_counter() - begun < 1
    for k in range(300):
        a = r.integers(0, 1 << (3 if k % 2 else 40), 60).astype(np.uint64)
        b = np.delete(a, r.integers(0, 60, r.integers(0, 6)))
        b = np.r_[b[20:], b[:20]] if k % 5 == 0 else b
        monkeypatch.setattr(near, "LONG", 10_000)
        plain = near.similarity(a, b)
        monkeypatch.setattr(near, "LONG", 0)
        assert near.similarity(a, b) == plain


def test_lines_that_share_a_segment_only_are_no_candidates(spark):
    rng = random.Random(5)
    texts = ["the same head of a line " + "".join(rng.choices(string.ascii_lowercase, k=48)) for _ in range(20)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "key long, line string, n int")
    parity = [sum(1 << c for c in range(64) if sum(ord(x) % 64 == c for x in t) % 2) for t in texts]
    allowed = sum((parity[i] ^ parity[j]).bit_count() <= 4 for i in range(20) for j in range(i))
    assert lines.candidates(table, 2, 20).count() == allowed < 20  # 190 pairs where a segment alone makes candidates
    top = lines.sized(table, 2).select(F.max(F.array_max(F.array(*lines.segment_keys()))).alias("m"), F.min(F.array_min(F.array(*lines.probe_keys(2, 20)))).alias("p")).first()
    assert 0 <= top["p"] and top["m"] < 1 << 40
