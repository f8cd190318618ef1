"""The models of importance resampling and language identification against plain loops, and all operators over one awkward table."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import byte_bpe, exact_dedup, importance, language_id, line_dedup, mixing, near_dedup, quality_rules, secrets, warc

LABELS = "doc_id long, quality int, toxic int"
WORDS = "river stone quiet morning walked under along between the of light hill paper window garden seldom answer".split()
M64 = (1 << 64) - 1


def plain_buckets(text):
    h = [zlib.crc32(w) for w in (text or "").encode().split()]
    mixed = [x * 0xFF51AFD7ED558CCD & M64 for x in h]
    for a, b in zip(h, h[1:]):
        two = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & M64
        mixed.append(two ^ two >> 29)
    return [(m >> 20) % importance.BUCKETS for m in mixed]


def test_importance_weights_by_loops(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS[: 6 + 11 * (i % 2)]) for _ in range(r.randrange(1, 60))) for i in range(50)] + [None, "", "é ß\tx"]
    labels = [(i, int(i % 2 == 0), 0) for i in range(40)] + [(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0), (45, 7, 0)]
    docs, known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    raw = Counter(b for t in texts for b in plain_buckets(t))
    good = [i for i in range(40) if i % 2 == 0 and i != 2]
    target = Counter(b for i in good for b in plain_buckets(texts[i]))
    n, m, size = sum(raw.values()), sum(target.values()), importance.BUCKETS
    ratio = [math.log((target[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size)) for b in range(size)]
    key = {}
    for i, t in enumerate(texts):
        b = plain_buckets(t)
        seed = xxhash.xxh64_intdigest(b"gumbel 0", 42)
        draw = xxhash.xxh64_intdigest(struct.pack("<q", i), seed) % (1 << 52)
        key[i] = (sum(ratio[x] for x in b) / len(b) if b else min(ratio)) * importance.EFFECTIVE_LENGTH - math.log(-math.log((draw + 0.5) / (1 << 52)))
    out = {x["doc_id"]: x for x in importance.importance_resampling(docs, known).collect()}
    assert all(abs(out[i]["sample_key"] - k) < 1e-6 for i, k in key.items())
    k = round(len(good) / 40 * len(texts))
    assert {i for i, x in out.items() if x["kept"]} == set(sorted(key, key=lambda i: -key[i])[:k])


def test_importance_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b"), (None, "c d")], "doc_id long, text string")
    out = importance.importance_resampling(docs, spark.createDataFrame([(1, 1, 0)], LABELS), keep_share=0.4).collect()
    assert len(out) == 5 and len({x["kept"] for x in out if x["doc_id"] == 1}) == 1


def plain_ngrams(text):
    t = "".join(c if c.isalpha() else "\0" for c in text.lower())
    points, out, m32 = [ord(c) for c in " " + re.sub("\0+", " ", t) + " "], Counter(), 0xFFFFFFFF
    a, b, c = language_id._MIX
    for n in range(1, language_id.LONGEST + 1):
        for i in range(len(points) - n + 1):
            code = 0
            for j in range(n):
                code = (code * c ^ (points[i + j] + j) * a) & m32
            out[((code ^ code >> 15) * b & m32) >> 32 - language_id.BITS] += 1
    return out


def test_ngrams_by_loops():
    r = random.Random(5)
    for text in ["a", "--Ab  c1d", "éß 日本 x", *("".join(r.choice("abcé ß-1 \n") for _ in range(r.randrange(1, 80))) + "q" for _ in range(60))]:
        at, n = language_id.ngram_counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == dict(plain_ngrams(text))
    assert language_id.ngram_counts("12 !?") is None and language_id.ngram_counts(None) is None


def test_idf_and_vectors_by_loops(spark):
    texts = ["aba", "ab cd", "cd cd cd", "12", "xyz"]
    rows = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    seen = Counter(f for t in texts if t != "12" for f in plain_ngrams(t))
    assert all(abs(model.idf[f] - (math.log(5 / (1 + seen[f])) + 1)) < 1e-12 for f in [*seen, 0, 1, 2])
    counts = plain_ngrams("ab cd cd")
    raw = {f: (1 + math.log(n)) * model.idf[f] for f, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    at, x = model.vector("ab cd cd")
    assert all(abs(v - raw[f] / norm) < 1e-12 for f, v in zip(at.tolist(), x.tolist())) and len(at) == len(raw)


def test_ftrl_by_loops():
    r = random.Random(3)
    rows = [((np.array(sorted(r.sample(range(9), 4))), np.array([r.random() for _ in range(4)])), r.randrange(3)) for _ in range(12)]
    model = language_id.Model(["a", "b", "c"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 3)), np.zeros(3))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.1, 0.05
    language_id.ftrl(model, rows, 2, alpha, beta, l1, l2)
    z, n = Counter(), Counter()

    def weight(f, k):
        return 0.0 if abs(z[f, k]) <= l1 else -math.copysign(1, z[f, k]) * (abs(z[f, k]) - l1) / ((beta + math.sqrt(n[f, k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            (at, x), y = rows[i]
            pairs = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            w = {(f, k): weight(f, k) for f, _ in pairs for k in range(3)}
            s = [sum(v * w[f, k] for f, v in pairs) for k in range(3)]
            total = sum(math.exp(v) for v in s)
            for f, v in pairs:
                for k in range(3):
                    g = v * (math.exp(s[k]) / total - (k == y))
                    sigma = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha
                    z[f, k] += g - sigma * w[f, k]
                    n[f, k] += g * g
    for k in range(3):
        assert abs(model.bias[k] - weight("bias", k)) < 1e-9
        assert all(abs(model.weights[f, k] - weight(f, k)) < 1e-9 for f in range(9))
    assert (model.weights[9:] == 0).all() and (model.weights[:9] == 0).any()


def test_temperature_beats_a_grid():
    r = np.random.default_rng(1)
    rows = [(r.normal(size=3) * 4, int(r.integers(3))) for _ in range(60)]

    def loss(t):
        return sum(math.log(sum(math.exp(v / t) for v in z)) - z[y] / t for z, y in rows)

    best = language_id.calibrate(None, rows)
    assert all(loss(best) <= loss(t) + 1e-6 for t in np.geomspace(0.05, 20, 300)) and language_id.calibrate(None, []) == 1.0


def test_equal_scores_go_to_the_first_language():
    model = language_id.Model(["aa", "bb"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2)), np.zeros(2))
    assert model.predict("some text") == ("aa", 0.5)


CLASHES = ("_id", "_doc", "_gone", "_text", "_row", "_name", "_source", "_hash", "_stays", "_own_id", "id", "key", "ids", "kept", "block", "slot", "mix_position", "n_tokens", "line", "sig", "held_out", "spans", "record_type")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Null and repeated ids, equal rows, empty, odd and long texts, columns whose names clash."""
    r = random.Random(1)
    sentence = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = [sentence(70) + "\n" + sentence(30) + "." for _ in range(30)]
    texts = [*base, base[0], base[0], base[1].upper(), base[2] + " extra", None, None, "", " \n\t", "word " * 20_000, "x" * 60_000, "a\x00b\n" * 3, "\U0001f600 é ß" * 40, "password = hunter2hunter2"]
    ids: list = list(range(len(texts)))
    ids[3] = ids[4] = None
    ids[6], ids[30] = 5, 0
    rows = [(i, t, ("en", None, "de")[k % 3], ("s", "s", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    path = str(tmp_path_factory.mktemp("awkward"))
    clash = lambda df: df.withColumns({c: F.lit("x") for c in CLASHES})
    clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(1, 0, 0), (None, 1, 0), (2, None, None)], LABELS).write.parquet(path + "/labels.parquet")
    return spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet"), ids, texts, path


def test_every_row_gets_its_row(spark, awkward):
    docs, labels, ids, texts, _ = awkward
    wanted = Counter(ids)
    results = {
        "lines": line_dedup.line_dedup(docs), "exact": exact_dedup.exact_dedup(docs), "importance": importance.importance_resampling(docs, labels), "rules": quality_rules.quality_rules(docs, labels), "language": language_id.language_id(docs),
        "near": near_dedup.near_dedup(docs), "mix": mixing.positions(docs), "tokens": byte_bpe.token_digests(docs),
    }
    found = {name: df.collect() for name, df in results.items()}
    for name, rows in found.items():
        assert Counter(x["doc_id"] for x in rows) == wanted, name
    text_of = {i: t or "" for i, t in zip(ids, texts) if wanted[i] == 1}
    for x in found["tokens"]:
        if x["doc_id"] in text_of:
            assert x["decoded_sha256"] == hashlib.sha256(text_of[x["doc_id"]].encode()).hexdigest()
    assert sorted(x["mix_position"] for x in found["mix"]) == list(range(len(ids)))
    groups = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts)
    assert sum(x["kept"] for x in found["exact"]) == len(groups)
    assert all(not x["kept"] for x in found["rules"] if not text_of.get(x["doc_id"], "x"))


def test_pipeline_over_awkward_rows(spark, awkward):
    import corpus_pipeline

    docs, labels, ids, texts, path = awkward
    good = quality_rules.keep_good(docs, labels)
    assert good.columns == docs.columns
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(x["mix_position"] for x in out) == list(range(len(out)))
    left = Counter(x["doc_id"] for x in out)
    assert set(left) <= set(ids) and left[None] <= 2 and left[0] + left[31] <= 1
    # clean texts without a copy stay as they are, those without or with a repeated id too
    alone = {hashlib.sha256(texts[i].encode()).hexdigest() for i in (3, 4, 5, 6, *range(7, 30))}
    rejected = {hashlib.sha256(x["text"].encode()).hexdigest() for x in docs.join(good, ["doc_id", "text"], "left_anti").where("text IS NOT NULL").collect()}
    assert alone - rejected <= {x["decoded_sha256"] for x in out}
    empty = path + "/empty"
    docs.limit(0).write.parquet(empty + "/documents.parquet")
    labels.limit(0).write.parquet(empty + "/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_archives_and_secrets_of_awkward_rows(spark, awkward):
    docs, _, ids, texts, _ = awkward
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "kept", "key", "slot")
    got = warc.archive_round_trip(pages).collect()
    assert Counter(x["page_id"] for x in got) == Counter(ids)
    long = [x for x in got if x["payload_bytes"] >= 100]
    assert all(x["record_type"] == "response" for x in got if x["payload_bytes"] < 100)
    # rows that repeat the smallest id of a payload are all responses: one such row here
    assert sum(x["record_type"] == "response" for x in long) == len({x["payload_digest"] for x in long}) + 1
    found = secrets.secret_scan(docs).collect()
    assert Counter(x["doc_id"] for x in found) == Counter(ids)
    assert [x["n_assign"] for x in found if x["doc_id"] == ids[-1]] == [1]


def test_pipeline_against_plain_loops(spark, tmp_path):
    """Every stage by loops over a corpus with bad documents, shared passages, exact and near copies; the verdict of the trained field is taken from its operator."""
    import corpus_pipeline

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = [line(20), line(20)]
    texts = ["\n".join(line(18) for _ in range(6)) for _ in range(60)]
    texts += ["\n".join([line(18), *passage, line(18), line(18), line(18)]) for _ in range(8)]
    texts += [texts[3], texts[3], texts[62]]
    words = [texts[k].replace("\n", " ").split(" ") for k in (10, 11)]
    texts += [" ".join(w[:60] + [word()] + w[61:]) for w in words]  # near copies, of one line each
    texts += ["\n".join(" ".join(f"{word().upper()}!!$$" for _ in range(20)) for _ in range(5)) for _ in range(20)]
    n_good = len(texts) - 20
    path = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(path + "/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < n_good), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(path + "/labels.parquet")
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, path).collect()}

    kept = {x["doc_id"] for x in quality_rules.quality_rules(spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet")).where("kept").collect()}
    assert set(range(n_good)) <= kept and not kept & set(range(n_good, len(texts)))

    seen, left = {}, {}
    for i in sorted(kept):
        first = next((j for j in sorted(left) if texts[j] == texts[i] and all(seen[x] == j for x in texts[i].split("\n"))), None)  # a copy of one that keeps all its lines
        rest = [x for x in texts[i].split("\n") if x not in seen]  # planted lines differ by far more than two edits, or not at all
        left[i] = texts[i] if first is not None else "\n".join(rest)
        for x in texts[i].split("\n"):
            seen.setdefault(x, i)

    def windows(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    groups = []
    for i, t in left.items():
        mine = next((g for g in groups if any(len(windows(left[j]) & windows(t)) >= 0.8 * len(windows(left[j]) | windows(t)) for j in g)), None)
        mine.append(i) if mine else groups.append([i])
    assert sorted(map(len, groups), reverse=True)[:4] == [3, 2, 2, 1] and left[70] == "" and passage[0] not in left[62]
    assert all(sum(i in out for i in g) == 1 for g in groups) and len(out) == len(groups)
    for i, x in out.items():
        assert x["decoded_sha256"] == hashlib.sha256(left[i].encode()).hexdigest()
    stayed = spark.createDataFrame([(i, left[i], f"s{i % 3}") for i in out], "doc_id long, text string, source string")
    places = {x["doc_id"]: x["mix_position"] for x in mixing.positions(stayed).collect()}
    assert {i: x["mix_position"] for i, x in out.items()} == places and sorted(places.values()) == list(range(len(out)))
