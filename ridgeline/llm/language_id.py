"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 code points of the lower-cased text with all but letters as single spaces; a
feature's weight in a text is (1 + ln count) * idf, with texts scaled to length one. The idf comes from all training rows, counted
in one pass: a task emits at most ``FEATURES`` counts. The regression is trained by follow-the-regularised-leader (FTRL-proximal, with
elastic-net penalties l1 and l2) on a bounded sample, ``per_language`` texts of each language at most, chosen by a hash of the id;
a fifth of the sample is left out of training and sets the temperature that calibrates the probabilities.

Scoring is one pass without a shuffle over whole texts; the weights (features x languages, of fixed size) are broadcast.

Defined results: a text that is null or has no letter is ``und`` with score 0; training rows need a language and a text with a
letter; without any, every text is ``und``; ties go to the language that comes first by name; lang, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BITS = 14
FEATURES = 1 << BITS
LONGEST = 3
PER_LANGUAGE = 600
HELD_OUT_FOLD = 2
FOLDS = 4
#: Hashing multipliers of the n-gram lengths: odd numbers, any will do.
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def is_letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        for i in range(0x110000):
            if chr(i).isalpha():
                table[i] = True
        _LETTERS.append(table)
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers, ascending, and counts; None if no letter stands in the text."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter_table()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    points = np.concatenate([[np.uint32(32)], points[np.concatenate([[True], letter[1:] | letter[:-1]])], [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(FEATURES, np.int64)
    code = np.zeros(len(points), np.uint32)
    for n in range(LONGEST):
        if len(points) <= n:
            break
        code = (code[: len(points) - n] * np.uint32(_MIX[2])) ^ (points[n:] + np.uint32(n)) * np.uint32(_MIX[0])
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(_MIX[1])
        total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequencies(texts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and of how many with a letter. Partial counts meet per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                if (found := ngram_counts(x.as_py())) is not None:
                    seen[found[0]] += 1
                    n += 1
        seen[FEATURES] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["feature", "n"])

    counts = texts.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[counts["feature"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out[:FEATURES], int(out[FEATURES])


def training_sample(rows: DataFrame, bound: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``bound`` (text, language) of each language, those of the smallest hashes of the id, or of the text where there is no id.

    Ids that repeat share a hash; the driver takes no more than twice what is asked for, the smallest hashes first.
    """
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return []
    rate = F.lit(0)
    for lang, n in sizes.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, 1.2 * bound / n) * (1 << 30)))).otherwise(rate)
    hashed = F.xxhash64(F.lit("language sample"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    few = rows.where(F.pmod(hashed, F.lit(1 << 30)) < rate).select(hashed.alias("_h"), lang_col, text_col)
    near = few.orderBy("_h", F.xxhash64(text_col)).limit(2 * bound * len(sizes)).collect()
    out, taken = [], dict.fromkeys(sizes, 0)
    for r in sorted(near, key=lambda r: (r["_h"], r[lang_col], r[text_col])):
        if taken[r[lang_col]] < bound:
            taken[r[lang_col]] += 1
            out.append((r[text_col], r[lang_col]))
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        found = ngram_counts(text)
        if found is None:
            return None
        at, n = found
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, text: str | None) -> np.ndarray | None:
        found = self.vector(text)
        return None if found is None else found[1] @ self.weights[found[0]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return UNKNOWN, 0.0
        z = z / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(model: Model, rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    """FTRL-proximal: per-coordinate rates, weights that are exactly zero until their gradients outweigh l1."""
    k = len(model.langs)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        held = np.abs(z[at]) - l1
        return np.where(held > 0, -np.sign(z[at]) * held / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            (at, x), y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
    final = weights(slice(None))
    model.weights, model.bias = final[:FEATURES], final[FEATURES]


def calibrate(model: Model, rows: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of the smallest negative log-likelihood, by golden-section search over its logarithm."""
    if not rows:
        return 1.0
    z, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Train on rows that have a language and a text."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    df, total = document_frequencies(rows, text_col)
    sample = training_sample(rows, per_language, id_col, text_col, lang_col)
    langs = sorted({lang for _, lang in sample})
    model = Model(langs, np.log((1 + total) / (1 + df)) + 1, np.zeros((FEATURES, len(langs))), np.zeros(len(langs)))
    vectors = [(v, langs.index(lang), text) for text, lang in sample if (v := model.vector(text)) is not None]
    aside = [i % 5 == 4 for i in range(len(vectors))]
    ftrl(model, [(v, y) for (v, y, _), a in zip(vectors, aside) if not a], epochs, alpha, beta, l1, l2)
    model.temperature = calibrate(model, [(v[1] @ model.weights[v[0]] + model.bias, y) for (v, y, _), a in zip(vectors, aside) if a])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.predict(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.select(id_col, (fold(id_col) == HELD_OUT_FOLD).alias("held_out"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the folds that are not held out; predict for every document."""
    return predict(docs, fit(docs.where(fold() != HELD_OUT_FOLD), per_language))
