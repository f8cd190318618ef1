"""Rasters as 16-bit PNG strips with a JSON sidecar, as a Spark data source that reads and writes.

A raster is a folder of any store that pyarrow reaches: PNG files of some rows each, and ``raster.json``, which says where the raster lies and which files
it is made of, from the top. Reading takes a partition a strip, only those whose rows a filter on y asks for. Writing takes a task's strips under names of the run;
they count only once the sidecar has been written, last of all, so a failed write leaves nothing behind.

Heights are stored in tenths of metres over -100, 0 for none; four bands (red, green, blue, nir) as whole numbers, 0 for none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..sinks.export import decode_heights, encode_heights, png16, read_png16

BANDS = ("red", "green", "blue", "nir")
SIDECAR = "raster.json"
#: What the sidecar says of the encoding.
ENCODINGS = {1: "value = pixel / 10 - 100, 0 = no data", 4: "RGBA16 = red, green, blue, near infrared; reflectance x 10000; 0 = no data"}


class Bounds:
    """The least and most of the whole numbers y and x that filters leave; Spark applies the filters themselves again."""

    def __init__(self) -> None:
        self.low, self.high = {"y": -(1 << 62), "x": -(1 << 62)}, {"y": 1 << 62, "x": 1 << 62}

    def narrow(self, filters: list[Filter]) -> list[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name not in self.low:
                continue
            values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) else []
            if not values:
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In)):
                self.low[name] = max(self.low[name], min(values) + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, In)):
                self.high[name] = min(self.high[name], max(values) - isinstance(f, LessThan))
        return filters

    def meets(self, axis: str, first: int, n: int) -> bool:
        return first <= self.high[axis] and first + n - 1 >= self.low[axis]


def pushdown(spark: SparkSession) -> None:
    """Filters reach Python data sources only if the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def sidecar(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_file(f"{root}/{SIDECAR}") as f:
        return json.loads(f.read())


class Strip(InputPartition):
    def __init__(self, file: str, first: int, rows: int):
        self.file, self.first, self.rows = file, first, rows


class StripReader(DataSourceReader):
    def __init__(self, path: str, meta: dict):
        self.path, self.meta, self.bounds = path, meta, Bounds()

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self.bounds.narrow(filters)

    def partitions(self) -> list[Strip]:
        return [Strip(s["file"], s["y"], s["rows"]) for s in self.meta["strips"] if self.bounds.meets("y", s["y"], s["rows"])]

    def read(self, strip: Strip | None) -> Iterator:
        import pyarrow as pa

        if strip is None:
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{strip.file}") as f:
            raw = read_png16(f.read())
        y, x = (a.ravel() for a in np.indices(raw.shape[:2]))
        columns = {"y": pa.array(y + strip.first, pa.int32()), "x": pa.array(x, pa.int32())}
        if raw.ndim == 2:
            z = decode_heights(raw).ravel()
            columns["value"] = pa.array(z, pa.float64(), mask=np.isnan(z))
        else:
            for i, band in enumerate(BANDS):
                v = raw[:, :, i].ravel()
                columns[band] = pa.array(v.astype(np.int32), pa.int32(), mask=v == 0)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Written(WriterCommitMessage):
    def __init__(self, strips: list[tuple[str, int, int]]):
        self.strips = strips


class StripWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.meta, self.overwrite, self.run = options["path"], json.loads(options["meta"]), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        done = []
        for r in rows:
            if r.png is None:
                raise ValueError("a strip without an image")
            name = f"{self.run}-{r.y:09d}.png"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(bytes(r.png))
            done.append((name, r.y, r.rows))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        strips = sorted((s for m in messages if m for s in m.strips), key=lambda s: s[1])
        if not self.overwrite and store.get_file_info(f"{root}/{SIDECAR}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds a raster")
        store.create_dir(root, recursive=True)
        before = [s["file"] for s in sidecar(self.path)["strips"]] if store.get_file_info(f"{root}/{SIDECAR}").type == fs.FileType.File else []
        full = self.meta | {"strips": [{"file": f, "y": y, "rows": n} for f, y, n in strips]}
        with store.open_output_stream(f"{root}/.{self.run}.json") as f:
            f.write(json.dumps(full, indent=1, sort_keys=True).encode())
        store.move(f"{root}/.{self.run}.json", f"{root}/{SIDECAR}")
        for name in before:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Whatever tasks of this run have written, those that failed included."""
        from pyarrow import fs

        store, root = _store(self.path)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith((self.run, f".{self.run}")):
                store.delete_file(info.path)


class StripRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strip_raster"

    def schema(self) -> str:
        bands = sidecar(self.options["path"])["bands"]
        return "y int, x int, " + ("value double" if bands == 1 else ", ".join(f"{b} int" for b in BANDS))

    def reader(self, schema) -> StripReader:
        return StripReader(self.options["path"], sidecar(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> StripWriter:
        return StripWriter(self.options, overwrite)


def strip_rows(grid: DataFrame, bands: int, width: int, rows: int, value: str = "z") -> DataFrame:
    """(y, rows, png): strips of ``rows`` rows of a grid that begins at (0, 0); a task encodes one strip."""
    names = [value] if bands == 1 else list(BANDS)

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * rows
        n = int(pdf["_h"].iloc[0]) - first if first + rows > pdf["_h"].iloc[0] else rows
        raw = np.full((n, width, len(names)), np.nan)
        raw[pdf["y"].to_numpy() - first, pdf["x"].to_numpy()] = pdf[names].to_numpy(float)
        image = encode_heights(raw[:, :, 0]) if bands == 1 else np.nan_to_num(raw).clip(0, 65535).astype(np.uint16)
        return pd.DataFrame({"y": [first], "rows": [n], "png": [png16(image)]})

    return grid.select("y", "x", *names, "_h", F.floor(F.col("y") / rows).alias("_strip")).groupBy("_strip").applyInPandas(encode, "y int, rows int, png binary")


def write_strips(grid: DataFrame, path: str, meta: dict, bands: int = 1, rows: int = 256, value: str = "z", overwrite: bool = False) -> None:
    """Write a grid (y, x, ``value`` or the four bands) that begins at (0, 0). ``meta`` says where it lies (crs, x0, y0, res) and what else there is to say.

    Rows without any cell stand in the file as such if their strip has one; a strip without a cell is left out.
    """
    spark = grid.sparkSession
    spark.dataSource.register(StripRaster)
    bottom, right = grid.agg(F.max("y"), F.max("x")).first()
    height, width = (bottom if bottom is not None else -1) + 1, (right if right is not None else -1) + 1
    full = {"encoding": ENCODINGS[bands], "bands": bands, "w": width, "h": height} | meta
    strips = strip_rows(grid.withColumn("_h", F.lit(height)), bands, width, rows, value)
    strips.write.format("strip_raster").mode("overwrite" if overwrite else "append").option("path", path).option("meta", json.dumps(full)).save()


def read_strips(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, value) or (y, x, red, green, blue, nir); missing values null."""
    pushdown(spark)
    spark.dataSource.register(StripRaster)
    return spark.read.format("strip_raster").option("path", path).load()
