"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the vocabulary.

The vocabulary (base64 piece and rank per line) is written out as a sentencepiece BPE model: byte b is the
letter U+0100+b, a piece is its bytes so mapped, its score the negative rank, its id the rank; the normaliser
is the identity, with no dummy prefix and no treatment of spaces. sentencepiece merges the pair of highest
score, leftmost first, which is the merge of lowest rank, so each pre-token gets the ids that a rank-merging
encoder gives it. A pre-token that is itself a piece is that piece. Decoding maps ids to pieces and
pieces back to bytes.

Pre-tokens are encoded once per worker and kept in a bounded dictionary; no document is ever held twice, and
nothing is shuffled. A lost task is simply run again.

Defined results: null is the empty text, with no ids; further columns are carried along by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED_PIECES = 200_000
CACHED_CHARS = 64
#: Unicode's White_Space, spelt out: what \s means differs between regex engines.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank. Ranks have to be 0, 1, 2, ... without a gap, and all 256 bytes have to be pieces."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in file if line.strip())}
    pieces = [found[i] for i in range(len(found))]
    missing = {bytes([b]) for b in range(256)} - set(pieces)
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    return pieces


def letters(data: bytes) -> str:
    """Bytes as letters of one code point each."""
    return data.decode("latin-1").translate(_LETTER)


_LETTER = {b: 0x100 + b for b in range(256)}
_BYTE = {0x100 + b: b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; the unknown piece, which never comes up, takes the id after the last rank."""
    out = [_field(1, _field(1, letters(p).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


def pre_token_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, so that it splits alike in every engine."""
    import re

    spelt = re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern)
    return spelt.replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")


class Codec:
    """Encodes texts to packed ids (little-endian unsigned 32 bits) and decodes them."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = pieces
        self.split = regex.compile(pre_token_pattern(pattern)).findall
        model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(pieces))
        known = {p: struct.pack("<I", rank) for rank, p in enumerate(pieces)}

        class Cache(dict):
            def __missing__(self, token: str) -> bytes:
                data = token.encode()
                packed = known.get(data)
                if packed is None:
                    ids = model.encode(letters(data))
                    packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(token) <= CACHED_CHARS:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[token] = packed
                return packed

        self.cache = Cache()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        ids = memoryview(packed).cast("I").tolist() if packed else []
        return b"".join(map(self.pieces.__getitem__, ids))


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec for each worker process, however many tasks it runs."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        pieces = vocabulary.split(b"\n")
        _CODECS[key] = Codec([base64.b64decode(p) for p in pieces], pattern)
    return _CODECS[key]


_CODECS: dict[tuple[bytes, str], Codec] = {}


def _shipped(df: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary, of fixed size, is read on the driver and broadcast."""
    import public_tokenizers

    pieces = read_ranks(path or vocabulary_path())
    return df.sparkSession.sparkContext.broadcast(b"\n".join(map(base64.b64encode, pieces))), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and the packed ids of every whole text, as binary."""
    vocabulary, pattern = _shipped(docs, path, pattern)
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_col]) if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            ids = [codec.encode(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, out_col])

    from pyspark.sql import functions as F

    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "bytes", path: str | None = None) -> DataFrame:
    """The further columns and the decoded bytes."""
    vocabulary, pattern = _shipped(tokens, path, None)
    kept = [c for c in tokens.columns if c not in (ids_col, out_col)]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            texts = [codec.decode(x.as_py() or b"") for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, out_col])

    return tokens.mapInArrow(run, schema)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and the packed ids, and the columns named in ``carry``) of every whole text, encoded and decoded again in one pass.

    Rows keep the order in which they come."""
    vocabulary, pattern = _shipped(docs, path, pattern)
    schema = T.StructType([docs.schema[id_col], *DIGESTS.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else []), *(docs.schema[c] for c in carry)])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()][: 4 if with_ids else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            found = []
            for x in batch.column("_text"):
                packed = codec.encode(x.as_py())
                found.append((len(packed) // 4, sha(packed), sha(codec.decode(packed)), packed))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), *(batch.column(f"_carry{i}") for i in range(len(carry)))], names=schema.names)

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry))).mapInArrow(run, schema)
