"""Quality rules by labelling lines: a linear-chain conditional random field marks content or boilerplate.

Every line with a word gets a few binned features of its own; Viterbi decoding finds the best sequence of labels, and
the content's share of the characters decides retention. Two base rules come first: a text of under ``MIN_WORDS`` words, or one
of whose words over half stand in repeated three-word windows, is rejected whatever the labels.

The field is trained by maximum likelihood (Adam on the exact gradient by forward-backward, L2 penalty) on a bounded
sample of labelled documents, ``train_docs`` at most, chosen by a hash of the id: lines of documents of quality 0 count as
boilerplate, lines of documents of quality 1 as content but for those equal to an earlier line of theirs. Its weights are some
dozens of numbers and travel in the closure. Scoring is one pass without a shuffle; each document is worked on alone,
so a hot source or a very long document moves nothing.

Defined results: null and empty texts have no words and are rejected by the base rule; without labelled documents
every line is content, so that the base rules decide alone; several labels of one id have to agree, else that id is not used
for training; further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
CONTENT_SHARE = 0.5
TRAIN_DOCS = 1000
TRAIN_CHUNK = 32

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"
#: Bins of each feature group; the groups follow one another in the weight vector.
GROUPS = {"words": 8, "word_length": 6, "symbols": 6, "upper": 6, "digits": 5, "marks": 5, "distinct": 6, "end": 3, "again": 2, "markup": 2}
OFFSETS = dict(zip(GROUPS, np.concatenate([[0], np.cumsum(list(GROUPS.values()))[:-1]]).tolist()))
N_FEATURES = sum(GROUPS.values())


def _bin(x: float, edges: tuple[float, ...]) -> int:
    for i, e in enumerate(edges):
        if x < e:
            return i
    return len(edges)


def line_features(line: bytes, again: bool) -> tuple[int, ...]:
    """Indices of the features of a line that has a word; one of each group."""
    n = len(line)
    words = line.split()
    last = words[-1][-1:]
    o = OFFSETS
    return (
        o["words"] + min(7, len(words).bit_length()),
        o["word_length"] + _bin(n / len(words), (3.0, 4.5, 6.0, 9.0, 14.0)),
        o["symbols"] + _bin((n - len(line.translate(None, _SYMBOLS))) / len(words), (0.001, 0.05, 0.2, 0.6, 1.5)),
        o["upper"] + _bin((n - len(line.translate(None, _UPPER))) / n, (0.001, 0.05, 0.15, 0.3, 0.5)),
        o["digits"] + _bin((n - len(line.translate(None, _DIGITS))) / n, (0.001, 0.05, 0.2, 0.5)),
        o["marks"] + _bin((n - len(line.translate(None, _MARKS))) / len(words), (0.001, 0.1, 0.5, 1.2)),
        o["distinct"] + _bin(len(set(words)) / len(words), (0.15, 0.3, 0.5, 0.7, 0.9)),
        o["end"] + (0 if last in b".!?" else 1 if last in b",;:)|" else 2),
        o["again"] + again,
        o["markup"] + (b"<" in line or b"{" in line or b"http" in line),
    )


def lines_of(data: bytes) -> list[tuple[bytes, bool]]:
    """Lines with a word, and whether each equals an earlier one."""
    seen: set[bytes] = set()
    out = []
    for line in data.split(b"\n"):
        if line.strip():
            out.append((line, line in seen))
            seen.add(line)
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand in the text twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
        codes = pair[:-1] * len(number) + ids[2:]
    else:
        codes = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_signals(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, _SPACE))
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, _SYMBOLS)),
        sum(again for _, again in lines_of(data)),
        repeated_words(words),
    )


@dataclass
class Field:
    """Emission weights (features x 2), start weights (2) and transition weights (2 x 2). Label 0 is content."""

    emit: np.ndarray
    start: np.ndarray
    move: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        """Every line is content."""
        return cls(np.zeros((N_FEATURES, 2)), np.array([1.0, 0.0]), np.array([[1.0, 0.0], [1.0, 0.0]]))

    def decode(self, features: list[tuple[int, ...]]) -> list[int]:
        """The labels of the best sequence; ties go to content."""
        gain = (self.emit[:, 1] - self.emit[:, 0]).tolist()
        (s00, s01), (s10, s11) = self.move.tolist()
        a, b = self.start.tolist()
        back = []
        for i, f in enumerate(features):
            g = math.fsum(gain[k] for k in f)
            if i:
                from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
                back.append((0 if from_a else 1, 0 if from_b else 1))
                a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11)
            b += g
        if not features:
            return []
        label = 0 if a >= b else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train_field(sequences: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 60, rate: float = 0.2, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty. All sequences advance together, padded to the longest."""
    if not sequences:
        return Field.blank()
    n, longest, groups = len(sequences), max(len(f) for f, _ in sequences), len(GROUPS)
    x = np.zeros((n, longest, groups), np.int64)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(sequences):
        x[i, : len(f)], y[i, : len(f)], live[i, : len(f)] = f, labels, True
    total = live.sum()
    gold_emit = np.zeros((N_FEATURES, 2))
    for label in (0, 1):
        np.add.at(gold_emit[:, label], x[live & (y == label)].ravel(), 1)
    gold_start = np.bincount(y[:, 0], minlength=2).astype(float)
    both = live[:, 1:] & live[:, :-1]
    gold_move = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4).reshape(2, 2).astype(float)
    theta = np.zeros(N_FEATURES * 2 + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = x[live]
    logsum = lambda z, axis: z.max(axis) + np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis))
    for t in range(1, rounds + 1):
        emit, start, move = theta[: N_FEATURES * 2].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2)
        score = emit[x].sum(2) * live[:, :, None]
        fore, aft = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = start + score[:, 0]
        for i in range(1, longest):
            step = logsum(fore[:, i - 1, :, None] + move, 1) + score[:, i]
            fore[:, i] = np.where(live[:, i, None], step, fore[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = logsum(move + (score[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
            aft[:, i] = np.where(live[:, i + 1, None], step, aft[:, i + 1])
        z = logsum(fore[:, -1], 1)
        node = np.exp(fore + aft - z[:, None, None])[live]
        edge = np.exp(fore[:, :-1, :, None] + move + (score[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(0)
        expect = np.stack([np.bincount(flat.ravel(), np.repeat(node[:, k], groups), N_FEATURES) for k in (0, 1)], 1)
        first = np.exp(fore[:, 0] + aft[:, 0] - z[:, None]).sum(0)
        grad = np.concatenate([(gold_emit - expect).ravel(), gold_start - first, (gold_move - edge).ravel()]) / total - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[: N_FEATURES * 2].reshape(-1, 2).copy(), theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy())


def training_sequences(rows: list[tuple[str | None, int]]) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    """Features and labels; long documents are cut into chunks, for training only."""
    out = []
    for text, quality in rows:
        lines = lines_of((text or "").encode())
        features = [line_features(line, again) for line, again in lines]
        labels = [int(quality == 0 or again) for _, again in lines]
        for i in range(0, len(lines), TRAIN_CHUNK):
            out.append((features[i : i + TRAIN_CHUNK], labels[i : i + TRAIN_CHUNK]))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, bound: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str | None, int]]:
    """About ``bound`` labelled texts, chosen by a hash of the id; the ids are few and bounded, so they are broadcast."""
    agreed = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("quality").alias("_top")).where("quality = _top").drop("_top")
    n = agreed.count()
    if not n:
        return []
    near = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(min(1.0, bound / n) * (1 << 30))
    chosen = agreed.where(near).orderBy(F.xxhash64(id_col), id_col).limit(bound)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).orderBy(id_col, text_col).limit(bound).collect()
    return [(r[text_col], r["quality"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    return train_field(training_sequences(training_rows(docs, labels, train_docs, id_col, text_col)))


SIGNALS = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()),
])


def judge(text: str | None, field: Field, content_share: float = CONTENT_SHARE) -> tuple:
    """The signals, the base rules' and the method's verdict, and the content's share of the characters."""
    text = text or ""
    signals = base_signals(text)
    failed = signals[0] < MIN_WORDS or 100 * signals[4] > MAX_REPEATED_PERCENT * signals[0]
    lines = lines_of(text.encode())
    labels = field.decode([line_features(line, again) for line, again in lines])
    size = sum(len(line) for line, _ in lines)
    share = sum(len(line) for (line, _), label in zip(lines, labels) if label == 0) / size if size else 0.0
    return (*signals, failed, not failed and share >= content_share, share)


def score(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the signals of every document."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *SIGNALS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        for batch in batches:
            found = list(zip(*(judge(x.as_py(), field, content_share) for x in batch.column("_text")))) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(found, kinds))], names=schema.names)

    return docs.select(*keep, whole_text(text_col).alias("_text")).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, content_share: float = CONTENT_SHARE, train_on: DataFrame | None = None) -> DataFrame:
    """doc_id, the five signals, base_failed, kept and content_share of every document."""
    return score(docs, fit(train_on if train_on is not None else docs, labels, train_docs), content_share)


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that the rules keep, with all their columns. Decided in the same pass; nothing is joined."""
    field = fit(docs, labels, train_docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(x.as_py(), field, content_share)[6] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
