"""Tiled GeoTIFF (also BigTIFF) as a Spark data source: one partition per tile of a window.

spark.read.format("tiled_tiff").option("path", ...).option("level", 0).option("window", "x0,y0,w,h").load() gives (y, x, value), missing values null.
"""

from __future__ import annotations

import math
import struct
import time
import urllib.request
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from .strips import Bounds, pushdown

#: TIFF tags and the sizes of field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 277: "samples", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tiepoint", 42113: "nodata"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def fetch(path: str, start: int, size: int, tries: int = 4, pause: float = 0.8) -> bytes:
    """Bytes of a file or of a web resource; failed requests are repeated after growing pauses. A short read at the end is fine."""
    if not path.startswith(("http://", "https://")):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with store.open_input_file(at) as file:
            file.seek(min(start, file.size()))
            return file.read(size)
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + size - 1}"}), timeout=60) as reply:
                return reply.read()
        except OSError:
            if attempt == tries:
                raise
            time.sleep(pause * attempt)
    raise AssertionError


@dataclass
class Level:
    """A directory of the file: one resolution."""

    fields: dict
    order: str

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "fields":
            raise AttributeError(name)
        return self.fields.get(name)

    def one(self, name: str, default=None):
        v = self.fields.get(name)
        return v[0] if v else default


def levels(path: str) -> list[Level]:
    """The tiled directories, finest first. Offsets and counts of tiles are kept as places in the file where they don't fit the entry."""
    head = fetch(path, 0, 65536)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{path} is no TIFF")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, entry, word = (("Q", 20, "Q") if big else ("H", 12, "I"))
    room = 8 if big else 4

    def read(start: int, size: int) -> bytes:
        return head[start : start + size] if start + size <= len(head) else fetch(path, start, size)

    out = []
    while at:
        n = struct.unpack(order + count, read(at, struct.calcsize(count)))[0]
        body = read(at + struct.calcsize(count), n * entry + room)
        fields: dict = {}
        for i in range(n):
            tag, kind = struct.unpack(order + "HH", body[i * entry : i * entry + 4])
            size = struct.unpack(order + word, body[i * entry + 4 : i * entry + 4 + room])[0]
            if tag not in TAGS or kind not in TYPES:
                continue
            code = TYPES[kind]
            bytes_ = struct.calcsize("=" + code) * size
            value = body[i * entry + 4 + room : i * entry + 4 + 2 * room]
            where = None if bytes_ <= room else struct.unpack(order + word, value)[0]
            if TAGS[tag] in ("offsets", "counts"):
                fields[TAGS[tag]] = (code, size, where, value)
                continue
            data = value[:bytes_] if where is None else read(where, bytes_)
            fields[TAGS[tag]] = (data.rstrip(b"\0").decode(),) if code == "s" else struct.unpack(order + code * size, data)
        at = struct.unpack(order + word, body[n * entry : n * entry + room])[0]
        if "tile_width" in fields:
            out.append(Level(fields, order))
    return out


def index_slice(path: str, level: Level, name: str, first: int, last: int) -> tuple[int, ...]:
    """Entries first to last of the offset or count index, by one ranged read."""
    code, size, where, value = level.fields[name]
    width = struct.calcsize("=" + code)
    data = value[first * width : (last + 1) * width] if where is None else fetch(path, where + first * width, (last + 1 - first) * width)
    return struct.unpack(level.order + code * (last + 1 - first), data)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes from 9 to 12 bits, widths change one code early."""
    out, table = bytearray(), []
    bits = n = 0
    width, last = 9, b""
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            n -= width
            code = bits >> n & (1 << width) - 1
            bits &= (1 << n) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if last:
                table.append(last + (table[code] if code < len(table) else last)[:1])
            word = table[code]
            out += word
            last = word
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def sample_type(level: Level) -> np.dtype:
    kind = {1: "u", 2: "i", 3: "f"}[level.one("format", 1)]
    return np.dtype(f"{level.order}{kind}{level.one('bits', 8) // 8}")


def decode_tile(level: Level, data: bytes) -> np.ndarray:
    """Values of a tile as doubles, rows by columns, first sample; missing ones NaN."""
    h, w, samples = level.one("tile_height"), level.one("tile_width"), level.one("samples", 1)
    kind = sample_type(level)
    if not data:
        return np.full((h, w), np.nan)
    packing, predictor = level.one("compression", 1), level.one("predictor", 1)
    raw = data if packing == 1 else lzw(data) if packing == 5 else zlib.decompress(data) if packing in (8, 32946) else None
    if raw is None:
        raise ValueError(f"compression {packing} is unknown")
    raw = raw[: h * w * samples * kind.itemsize].ljust(h * w * samples * kind.itemsize, b"\0")
    if predictor == 3:
        # byte planes of each row, most significant first, differenced as one run of bytes
        rows = np.frombuffer(raw, np.uint8).reshape(h, -1, samples) if samples == 1 else np.frombuffer(raw, np.uint8).reshape(h, -1)[:, :, None]
        planes = np.cumsum(rows[:, :, 0], axis=1, dtype=np.uint64).astype(np.uint8).reshape(h, kind.itemsize, w * samples)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, samples)
    else:
        values = np.frombuffer(raw, kind).reshape(h, w, samples)
        if predictor == 2:
            whole = values.astype(kind.newbyteorder("="))
            values = np.cumsum(whole, axis=1, dtype=whole.dtype)
    out = values[:, :, 0].astype(float)
    nodata = level.one("nodata")
    if nodata is not None:
        try:
            out[out == float(nodata)] = np.nan
        except ValueError:
            pass
    return out


def georeference(level: Level) -> tuple[float, float, float, float]:
    """Left, top, cell width, cell height of the finest level."""
    sx, sy = level.scale[:2]
    i, j, _, x, y = level.tiepoint[:5]
    return x - i * sx, y + j * sy, sx, sy


def overview_for(levels_: list[Level], target: float) -> int:
    """The coarsest level that isn't coarser than a resolution."""
    _, _, cell, _ = georeference(levels_[0])
    sizes = [cell * levels_[0].one("width") / lv.one("width") for lv in levels_]
    return max((i for i, s in enumerate(sizes) if s <= target * 1.0001), key=lambda i: sizes[i], default=0)


class Tile(InputPartition):
    def __init__(self, tx: int, ty: int):
        self.tx, self.ty = tx, ty


class TiledTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = levels(self.path)[int(options.get("level", 0))]
        whole = f"0,0,{self.level.one('width')},{self.level.one('height')}"
        self.window = tuple(int(v) for v in options.get("window", whole).split(","))
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Comparisons of y and x with constants leave out tiles; Spark applies them again to the cells."""
        return self.bounds.narrow(filters)

    def partitions(self) -> list[Tile]:
        """Only tiles that the window and the filters on y and x meet, and the file has."""
        x, y, w, h = self.window
        tw, th = self.level.one("tile_width"), self.level.one("tile_height")
        across, down = math.ceil(self.level.one("width") / tw), math.ceil(self.level.one("height") / th)
        rows = [j for j in range(max(0, y // th), min(down, -(-(y + h) // th))) if self.bounds.meets("y", j * th, th)]
        columns = [i for i in range(max(0, x // tw), min(across, -(-(x + w) // tw))) if self.bounds.meets("x", i * tw, tw)]
        return [Tile(i, j) for j in rows for i in columns]

    def read(self, tile: Tile | None):
        import pyarrow as pa

        if tile is None:  # no tile is left
            return
        tw, th = self.level.one("tile_width"), self.level.one("tile_height")
        k = tile.ty * math.ceil(self.level.one("width") / tw) + tile.tx
        (offset,), (size,) = index_slice(self.path, self.level, "offsets", k, k), index_slice(self.path, self.level, "counts", k, k)
        values = decode_tile(self.level, fetch(self.path, offset, size) if size else b"")
        yy, xx = np.indices(values.shape)
        yy, xx = yy.ravel() + tile.ty * th, xx.ravel() + tile.tx * tw
        x, y, w, h = self.window
        on = (xx >= max(x, 0)) & (xx < min(x + w, self.level.one("width"))) & (yy >= max(y, 0)) & (yy < min(y + h, self.level.one("height")))
        v = values.ravel()[on]
        yield pa.RecordBatch.from_arrays([pa.array(yy[on], pa.int32()), pa.array(xx[on], pa.int32()), pa.array(v, pa.float64(), mask=np.isnan(v))], names=["y", "x", "value"])


class TiledTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return "y int, x int, value double"

    def reader(self, schema) -> TiledTiffReader:
        return TiledTiffReader(self.options)


def read_tiled(spark: SparkSession, path: str, level: int = 0, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    pushdown(spark)
    spark.dataSource.register(TiledTiff)
    reader = spark.read.format("tiled_tiff").option("path", path).option("level", level)
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load()


def projected_window(forward, box: tuple[float, float, float, float], frame: tuple[float, float, float, float], margin_m: float, steps: int = 40) -> tuple[int, int, int, int]:
    """Pixels x0, y0, w, h that hold a box of degrees once projected: its border is walked, as it bends."""
    west, south, east, north = box
    edge = [(west + (east - west) * i / steps, lat) for i in range(steps + 1) for lat in (south, north)] + [(lon, south + (north - south) * i / steps) for i in range(steps + 1) for lon in (west, east)]
    xs, ys = zip(*(forward(lon, lat) for lon, lat in edge))
    left, top, dx, dy = frame
    x0, x1 = math.floor((min(xs) - margin_m - left) / dx), math.ceil((max(xs) + margin_m - left) / dx)
    y0, y1 = math.floor((top - max(ys) - margin_m) / dy), math.ceil((top - min(ys) + margin_m) / dy)
    return x0, y0, x1 - x0, y1 - y0
