"""Quality, importance, language, archives, secrets, tokens, mixing and the pipeline."""

import base64
import hashlib
import io
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import byte_bpe, importance, language_id, mixing, quality_rules, secrets, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int"


def docs_of(spark, texts, langs=None, sources=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", 1) for i, t in enumerate(texts)], DOCS)


def corpus(n=160):
    r = random.Random(4)
    words = ["river", "stone", "quiet", "morning", "walked", "under", "along", "between", "the", "a", "of", "light", "hill", "paper", "window", "garden", "seldom", "answer"]
    good = [" ".join(r.choice(words) for _ in range(80)) + "." for _ in range(n)]
    bad = ["\n".join(" ".join(f"{r.choice(words).upper()}!!$$" for _ in range(20)) for _ in range(5)) for _ in range(n // 4)]
    texts = good + bad
    labels = [(i, int(i < n), 0) for i in range(len(texts))]
    return texts, labels


TRICKY = [None, "", " \n\t", "a b c a b c", "x\n\nx\nX", "a\x85b\xa0c", "1 # $ <tag>|", "word " * 30_000, "é" * 10]


def test_base_signals():
    for text in TRICKY:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        triples = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        assert quality_rules.base_signals(text or "") == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered))


def test_viterbi_is_the_best_sequence():
    r = np.random.default_rng(2)
    f = quality_rules.Field(r.normal(size=(quality_rules.N_FEATURES, 2)), r.normal(size=2), r.normal(size=(2, 2)))
    for n in range(1, 8):
        x = [tuple(r.integers(0, quality_rules.N_FEATURES, 10)) for _ in range(n)]
        score = lambda y: f.start[y[0]] + sum(f.emit[k, y[i]] for i in range(n) for k in x[i]) + sum(f.move[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max((tuple(map(int, np.binary_repr(b, n))) for b in range(2**n)), key=score)
        assert tuple(f.decode(x)) == best


def test_quality_rules_learn(spark):
    texts, labels = corpus()
    docs, known = docs_of(spark, texts + TRICKY), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, known).collect()}
    assert len(got) == len(texts) + len(TRICKY)
    right = sum(got[i]["kept"] == bool(q) for i, q, _ in labels)
    assert right >= 0.95 * len(labels)
    assert all(not got[len(texts) + i]["kept"] for i in range(len(TRICKY)))
    kept = quality_rules.keep_good(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0
    assert all(r["kept"] for r in quality_rules.quality_rules(docs_of(spark, texts[:3]), none).collect())


def test_importance(spark):
    texts, labels = corpus()
    docs, known = docs_of(spark, texts + TRICKY), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = importance.importance_resampling(docs, known).toPandas().set_index("doc_id")
    k = round(out.shape[0] * 160 / 200)
    assert out["kept"].sum() == k
    assert set(out.index[out["kept"]]) == set(out["sample_key"].nlargest(k).index)
    assert sum(bool(out["kept"][i]) == bool(q) for i, q, _ in labels) >= 0.95 * len(labels)
    assert importance.importance_resampling(docs.limit(0), known).count() == 0
    values = spark.createDataFrame([(float(v),) for v in [5, 5, 5, 1, -2, 9]], "v double")
    assert [importance.kth_largest(values, "v", k) for k in (1, 2, 4, 5, 6)] == [9, 5, 5, 1, -2]


def test_language(spark):
    r = random.Random(6)
    voc = {"aa": ["kala", "mala", "talo", "sana"], "bb": ["street", "church", "strong", "thrift"]}
    langs = [r.choice(["aa", "bb"]) for _ in range(240)]
    texts = [" ".join(r.choice(voc[x]) for _ in range(30)) for x in langs]
    texts += [None, "", "123 !?", "x" * 100_000]
    langs += ["aa", None, "bb", None]
    got = {x["doc_id"]: x for x in language_id.language_id(docs_of(spark, texts, langs)).collect()}
    import zlib

    for i, t in enumerate(texts):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        if i < 240:
            assert got[i]["lang_pred"] == langs[i]
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3
    assert {x["lang_pred"] for x in language_id.language_id(docs_of(spark, ["a"], [None])).collect()} == {"und"}


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    big = "<p>same text</p>" * 20
    rows = [(1, "http://a\r\nb", big, ""), (2, None, big, ""), (3, "u", None, ""), (4, "u", "", ""), (5, "u", "tiny", ""), (6, "u", "tiny", ""), (7, "u", "é" * 70_000, ""), (9, "u", big, "")]
    rows += [(100 + i, "u", f"<html>page number {i} with words and words {i * i}</html>", "") for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_archives(pages, archive_bytes=600)
    assert manifest.count() > 4 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = min(j for j, _, h, _ in rows if (h or "").encode() == data)
        again = len(data) >= 100 and same != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", same if again else None)
        assert r["payload"] is None if again else bytes(r["payload"]) == data
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_checks():
    first, pack = warc.encode_archive(warc.train_dictionary([b"abc" * 50]))
    good = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    data = first + pack(good) + pack(good)
    assert list(warc.decode_archive(io.BytesIO(data).read, 7)) == [good, good] and warc.parse_record(good)["payload"] == b"hello"
    for bad in (data[:-3], b"\0" * 8 + data[8:], data[:5]):
        with pytest.raises(warc.WarcError):
            list(warc.decode_archive(io.BytesIO(bad).read))
    for bad in (good.replace(b"hello", b"hullo"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Type"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    r = random.Random(8)
    bits = ["password", "TOKEN", "secret", "api_key", "apikey", ": ", "=", "'", '"', " ", "abc", "abcdef12", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "😀", "\n", "ſecret", "Key", "ghp_" + "a" * 36]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, "", "secret: token: abcdefgh", "x" * 300_000 + " token=abcdefgh"] + ["password=hunter22"] * 50
    got = {x["doc_id"]: x for x in secrets.secret_scan(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
        listed = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(listed) and listed == sorted(listed, key=lambda s: int(s.split(":")[1]))


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    one = docs_of(spark, ["token=abcdefgh", "plain", "plain"])
    ledger = secrets.ledger_entries(one).cache()
    assert ledger.count() == 2
    two = docs_of(spark, ["token=abcdefgh", "plain", "secret=zyxwvuts"])
    assert secrets.ledger_entries(two, ledger=ledger).count() == 1
    assert secrets.ledger_entries(two, ledger=ledger, rule_version="2").count() == 3
    # over one folder: the second run scans one blob, a new version of the rules all
    folder = str(tmp_path / "ledger")
    secrets.secret_scan(one, folder=folder)
    assert secrets.read_ledger(spark, folder).count() == 2
    again = secrets.secret_scan(two, folder=folder)
    assert sorted(again.collect()) == sorted(secrets.secret_scan(two).collect())
    assert secrets.read_ledger(spark, folder).count() == 3
    secrets.secret_scan(two, folder=folder, rule_version="2")
    assert secrets.read_ledger(spark, folder).count() == 6


def test_patterns_read_blobs_only_once(spark):
    """No pattern stands below the de-duplication."""
    docs = docs_of(spark, ["token=abcdefgh"] * 3)
    plan = secrets.ledger_entries(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = plan[next(i for i, line in enumerate(plan) if "Aggregate" in line) + 1 :]
    assert any("regexp_extract_all" in line for line in plan) and not any("regexp_extract_all" in line for line in below)


def test_tokens_equal_those_of_rank_merging(spark):
    import public_tokenizers
    import tiktoken

    pieces = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    r = random.Random(7)
    texts = [None, "", "a" * 50_000, " " * 999, "it's  we'll\n\n x\x1cy　z 日本語 \U0001f600"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for alphabet in (" a\n'st", "  \t\n\x85　x1!", "éüñ日本 '!1") for _ in range(60)]
    got = {x["doc_id"]: x for x in byte_bpe.token_digests(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs_of(spark, texts), keep=["doc_id"])).collect()
    assert all(bytes(x["bytes"]) == (texts[x["doc_id"]] or "").encode() for x in back)


def test_vocabulary_needs_all_bytes(tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.read_ranks(str(tmp_path / "v"))


def test_schedule_deviates_by_less_than_a_block():
    r = random.Random(3)
    for _ in range(40):
        blocks = {f"s{i}": r.randint(1, 50) for i in range(r.randint(1, 8))}
        weights = {s: r.choice([1, 2, 5, 0.3, 7.7]) for s in blocks}
        done, now = dict.fromkeys(blocks, 0), -1
        for s, b, p in mixing.schedule(blocks, weights):
            assert b == done[s]
            if p != now:
                now, t, live = p, 0, {x for x in blocks if done[x] < blocks[x]}
                share, ran = mixing.as_fractions({x: weights[x] for x in live}), dict.fromkeys(live, 0)
            ran[s], done[s], t = ran[s] + 1, done[s] + 1, t + 1
            assert all(abs(share[x] * t - ran[x]) < 1 for x in live)
        assert done == blocks


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    r = random.Random(2)
    sources = [r.choice(["hot"] * 4 + ["a", "b", None]) for _ in range(700)]
    docs = docs_of(spark, ["t"] * 700, sources=sources).unionByName(docs_of(spark, ["t"] * 3, sources=["a"] * 3))
    out = mixing.positions(docs, {"hot": 1.0, "a": 1.0, "b": 2.0, None: 1.0}, 10).toPandas().sort_values("mix_position")
    assert out["mix_position"].tolist() == list(range(703))
    for _, part in out.groupby("source", dropna=False):
        assert part["source_rank"].tolist() == list(range(len(part))) and (part["block"] == part["source_rank"] // 10).all()
    order = [s for s in out.drop_duplicates("slot")["source"].head(5)]
    assert len(set(map(str, order))) == 4
    rows = mixing.mixed(docs, {"hot": 1.0, "a": 1.0, "b": 2.0, None: 1.0}, 10).collect()
    assert [x["doc_id"] for x in rows] == out["doc_id"].tolist() and len(rows[0]) == len(docs.columns)
    assert mixing.positions(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.as_fractions({"a": 0})


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts, labels = corpus(60)
    texts += [texts[0], texts[0] + " more", None]
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good, copies = set(range(60)), {0, len(texts) - 3, len(texts) - 2}
    assert len(out.keys() & copies) == 1 and good - copies <= out.keys() and len(out.keys() - good - copies) <= 1
    for r in out.values():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]


def test_pipeline_follows_the_mixture(spark, tmp_path):
    import corpus_pipeline
    from ridgeline.llm.common import materialise

    texts, labels = corpus(60)
    docs_of(spark, texts, sources=["abc"[i % 7 % 3] for i in range(len(texts))]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
    wanted = [r["doc_id"] for r in mixing.positions(docs).orderBy("mix_position").collect()]
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert [r["doc_id"] for r in rows] == wanted and [r["mix_position"] for r in rows] == list(range(len(wanted)))
    # also if the files between the stages are read in another order
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, str(tmp_path)).repartition(5, "doc_id") if name == "source_mixing" else stage(spark, docs, str(tmp_path))
    assert [r["doc_id"] for r in docs.collect()] == wanted
