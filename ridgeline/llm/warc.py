"""WARC archives compressed by Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` turns pages into .warc.zst files in a folder that all executors share; each task writes its own files,
cut at ``archive_bytes``, under names of its attempt, and returns their paths, so that only files of tasks that ended well are in
the manifest. ``read_archives`` reads the files of a manifest: it loads the dictionary from the skippable frame, decodes one
frame at a time with bounded memory, and checks version, headers, lengths, trailers and payload digests of each record.

Of pages with equal payloads of at least ``REVISIT_BYTES``, that with the smallest id is a response and others revisit it. Payloads are
grouped by SHA-256 and length with a map-side combine; only pages that revisit are looked up, by (id, digest), so a hot payload
never meets in one task.

Defined results: null html is the empty payload; a null url is written as a urn of the page; smaller payloads are always responses;
equal ids with equal payloads are all responses if theirs is the smallest id; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialise, whole_text

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_PAGES = 256
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive breaks the format."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; few or short samples, which the trainer refuses, are a raw one themselves."""
    import zstandard

    if not any(samples):
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, its trailer included. A revisit has no block."""
    name = "null" if page_id is None else str(page_id)
    target = "".join(c for c in url if c > " ") if url else f"urn:page:{name}"
    block = b"" if refers_to is not None else HTTP_HEAD.format(len(payload)).encode() + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        fields.append(("Content-Type", "application/http; msgtype=response"))
    else:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record whose format, lengths and digest hold."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or lines[0] != VERSION:
        raise WarcError(f"not a {VERSION.decode()} record: {data[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(": ")
        if not colon or key.lower() in fields:
            raise WarcError(f"bad or repeated header {line[:80]!r}")
        fields[key.lower()] = value
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if key not in fields:
            raise WarcError(f"no header {key}")
    if not fields["content-length"].isdigit():
        raise WarcError(f"bad length {fields['content-length']!r}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{len(rest) - 4} bytes where {length} were announced")
    name = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    out = {"page_id": None if name == "null" else int(name), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": digest, "refers_to": None, "payload": None}
    if fields["warc-type"] == "response":
        http, cut, payload = rest[:length].partition(b"\r\n\r\n")
        announced = [line.partition(b": ")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        if not cut or announced != [str(len(payload)).encode()]:
            raise WarcError("the payload has another length than its HTTP header says")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload has another digest than its header says")
        return out | {"payload": payload, "payload_bytes": len(payload)}
    if fields["warc-type"] != "revisit" or length or "warc-refers-to" not in fields or not fields.get("x-payload-length", "").isdigit():
        raise WarcError(f"a {fields['warc-type']} record with {length} bytes")
    return out | {"refers_to": int(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")), "payload_bytes": int(fields["x-payload-length"])}


def encode_archive(dictionary: bytes) -> tuple[bytes, Callable[[bytes], bytes]]:
    """The leading frame, and what turns a record into its frame."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary, packer.compress


def decode_archive(read: Callable[[int], bytes], chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    import zstandard

    def exactly(n: int) -> bytes:
        got = b""
        while len(got) < n and (more := read(n - len(got))):
            got += more
        if len(got) < n:
            raise WarcError("the archive ends within its first frame")
        return got

    magic, size = struct.unpack("<II", exactly(8))
    if magic != SKIPPABLE_MAGIC:
        raise WarcError(f"the archive begins with {magic:#x} and not with a dictionary")
    data = exactly(size)
    if data[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
    left = b""
    while left or (left := read(chunk)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise WarcError(f"broken frame: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            if not (left := read(chunk)):
                raise WarcError("the archive ends within a frame")
        yield b"".join(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_refers_to(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to."""
    rows = pages.select("page_id", "url", whole_text("html").alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = rows.select("page_id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= REVISIT_BYTES)
    shared = keys.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    revisits = keys.join(shared, "digest").where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    return rows.join(revisits, ["page_id", "digest"], "left")


def sample_dictionary(pages: DataFrame, bound: int = DICTIONARY_PAGES) -> bytes:
    """From at most ``bound`` pages, chosen by a hash of the id."""
    n = pages.count()
    if not n:
        return b""
    rate = min(1.0, 2 * bound / n)
    near = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(rate * (1 << 30))
    rows = pages.where(near & F.col("html").isNotNull()).select(F.substring("html", 1, 32768).alias("html"), F.xxhash64("page_id").alias("h"), "page_id").orderBy("h", "page_id", "html").limit(bound)
    return train_dictionary([r["html"].encode() for r in rows.collect()])


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) of the files that tasks have finished."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    dictionary = sample_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        first, pack = encode_archive(dictionary)
        out, done, written = None, [], 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                done[-1][2] = written

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
                    out, written = store.open_output_stream(f"{at}/{name}", compression=None), len(first)
                    out.write(first)
                    done.append([f"{folder}/{name}", 0, 0])
                frame = pack(record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py()))
                out.write(frame)
                written += len(frame)
                done[-1][1] += 1
                if written >= archive_bytes:
                    close()
        close()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    return materialise(with_refers_to(pages).mapInArrow(run, MANIFEST), "warc-manifest")


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
])
PAYLOAD = T.StructType([*RECORD.fields, T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())])


def read_archives(manifest: DataFrame, payloads: bool = True, batch_rows: int = 200) -> DataFrame:
    """The records of the archives named in column ``path``; with url and payload (null for revisits) if asked for."""
    schema = PAYLOAD if payloads else RECORD
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(schema)]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(schema.names, kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path"):
                store, at = _filesystem(path.as_py())
                rows: list[dict] = []
                with store.open_input_stream(at, compression=None) as stream:
                    for data in decode_archive(stream.read):
                        rows.append(parse_record(data))
                        if len(rows) == batch_rows:
                            yield pack(rows)
                            rows = []
                yield pack(rows)

    # a file is a unit of work: spread the few rows of the manifest
    spark = manifest.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(width).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(write_archives(pages), payloads=False)
