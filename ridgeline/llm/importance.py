"""Quality classification by importance resampling of hashed n-gram models, sampled by Gumbel top-k.

Words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two smoothed generative models give each bucket a probability: the raw model from
all n-grams of all documents, counted in one pass (a task emits ``BUCKETS`` counts at most), and the target model from a bounded sample of labelled
good documents, ``target_docs`` at most. A document's log importance weight is the mean log ratio of its n-grams times
``effective_length``, which keeps long and short texts comparable. Adding Gumbel noise, fixed by a hash of the id, and keeping the k
largest keys draws k documents without replacement in proportion to their weights.

k is ``keep_share`` of all rows; by default the share of good ones among all labels. The k-th largest key is found by refining a histogram of bounded size,
so the keys are never sorted or gathered; they are written to the shared folder once and scanned a few times.

Defined results: null and empty texts have no n-grams and take the smallest log ratio of all buckets; equal keys share one fate, so
that ties at the threshold are all kept; rows of one id, or without one, share one draw of noise; a document with labels of both kinds
counts as bad, a label without an id or outside 0 and 1 doesn't count; without good labels the ratio is zero and noise decides alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

BUCKETS = 10_000
TARGET_DOCS = 3000
EFFECTIVE_LENGTH = 200.0
SMOOTHING = 1.0
CACHED_WORDS = 300_000
BINS = 4096


class _Hashes(dict):
    """crc32 of words, kept in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def buckets_of(text: str | None, hashes: dict) -> np.ndarray:
    """The buckets of all words and word pairs of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([one * np.uint64(0xFF51AFD7ED558CCD), two ^ (two >> np.uint64(29))])
    return ((both >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def ngram_totals(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket comes up in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(BUCKETS, np.int64), _Hashes()
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(buckets_of(x.as_py(), hashes), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def target_sample(docs: DataFrame, labels: DataFrame, bound: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], float]:
    """At most ``bound`` good texts by a hash of the id, and the share of good ones among the labels (1 without labels)."""
    agreed = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    n, good = agreed.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not good:
        return [], 1.0
    hashed = F.xxhash64(F.lit("target"), id_col)
    near = F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, bound / good) * (1 << 30))
    ids = agreed.where((F.col("quality") == 1) & near).orderBy(hashed, id_col).limit(bound).select(id_col)
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).orderBy(id_col, text_col).limit(bound).collect()
    return [r[text_col] for r in rows], good / n


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def kth_largest(keys: DataFrame, col: str, k: int) -> float | None:
    """The exact k-th largest value (from 1), from histograms of BINS counts."""
    n, low, high = keys.agg(F.count(col), F.min(col), F.max(col)).first()
    if k < 1 or not n:
        return None
    left = min(k, n)
    within = keys
    while low < high:
        place = F.least(F.floor((F.col(col) - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
        rows = within.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        within = keys.where(F.col(col).between(low, high))
        if r["n"] <= BINS:
            return sorted((x[0] for x in within.select(col).collect()), reverse=True)[left - 1]
    return low


SCORES = T.StructType([T.StructField("log_ratio", T.DoubleType()), T.StructField("n_ngrams", T.LongType())])


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mean log ratio and number of n-grams of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema[id_col], *SCORES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hashes = shipped.value, _Hashes()
        least = float(ratio.min())
        for batch in batches:
            found = []
            for x in batch.column("_text"):
                b = buckets_of(x.as_py(), hashes)
                found.append((float(ratio[b].mean()) if len(b) else least, len(b)))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(a, pa.float64()), pa.array(b, pa.int64())], names=schema.names)

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def importance_resampling(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, target_docs: int = TARGET_DOCS, effective_length: float = EFFECTIVE_LENGTH, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, log_ratio, n_ngrams, sample_key and kept of every document."""
    texts, good_share = target_sample(docs, labels, target_docs, id_col, text_col)
    hashes, target = _Hashes(), np.zeros(BUCKETS, np.int64)
    for text in texts:
        target += np.bincount(buckets_of(text, hashes), minlength=BUCKETS)
    weighed = weigh(docs, log_ratios(ngram_totals(docs, text_col), target), id_col, text_col)
    uniform = (F.pmod(F.xxhash64(F.lit(f"gumbel {seed}"), id_col), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.col("log_ratio") * effective_length - F.log(-F.log(uniform))
    keys = materialise(weighed.withColumn("sample_key", key), "importance")
    k = round((good_share if keep_share is None else keep_share) * keys.count())
    threshold = kth_largest(keys, "sample_key", k)
    return keys.withColumn("kept", F.lit(False) if threshold is None else F.col("sample_key") >= F.lit(threshold))
