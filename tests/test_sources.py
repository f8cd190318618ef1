"""Readers and sinks: what is written is read again."""

import json
import struct
import zipfile
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geodesy
from ridgeline.sinks import export
from ridgeline.sources import cog, strips, vector_io


def lzw_encode(data: bytes) -> bytes:
    """The plain encoder, clearing at 4094 codes."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word], width)
        table[word + bytes([b])] = size
        size += 1
        if size == 4094:
            put(256, width)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        elif size == 1 << width and width < 12:
            width += 1
        word = bytes([b])
    put(table[word], width)
    put(257, width)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def write_tiff(path, z, kind, compression, predictor, tile=16, big=False, nodata=None):
    h, w = z.shape
    order = "<"
    dtype = np.dtype("<" + kind)
    tiles = []
    for ty in range(0, h, tile):
        for tx in range(0, w, tile):
            part = np.zeros((tile, tile), dtype)
            piece = z[ty : ty + tile, tx : tx + tile]
            part[: piece.shape[0], : piece.shape[1]] = piece
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(dtype)
                raw = part.tobytes()
            elif predictor == 3:
                planes = part.astype(dtype.newbyteorder(">")).view(np.uint8).reshape(tile, tile, dtype.itemsize).transpose(0, 2, 1).reshape(tile, -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            else:
                raw = part.tobytes()
            tiles.append(zlib.compress(raw) if compression == 8 else lzw_encode(raw) if compression == 5 else raw)
    head = 16 if big else 8
    at, offsets = head, []
    for t in tiles:
        offsets.append(at)
        at += len(t)
    extra, entries = b"", []
    base = at
    word = "Q" if big else "I"

    def add(tag, typ, values):
        nonlocal extra
        code = cog.TYPES[typ]
        data = values if typ == 2 else struct.pack(order + code * len(values), *values)
        room = 8 if big else 4
        if len(data) <= room:
            field = data.ljust(room, b"\0")
        else:
            field = struct.pack(order + word, base + len(extra))
            extra += data
        entries.append(struct.pack(order + "HH" + word, tag, typ, len(values)) + field)

    add(256, 4, [w]); add(257, 4, [h]); add(258, 3, [dtype.itemsize * 8]); add(259, 3, [compression]); add(277, 3, [1]); add(317, 3, [predictor])  # noqa: E702
    add(322, 4, [tile]); add(323, 4, [tile]); add(324, 16 if big else 4, offsets); add(325, 4, [len(t) for t in tiles]); add(339, 3, [{"u": 1, "i": 2, "f": 3}[kind[0]]])  # noqa: E702
    add(33550, 12, [30.0, 30.0, 0.0]); add(33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0])  # noqa: E702
    if nodata is not None:
        add(42113, 2, nodata.encode() + b"\0")
    ifd = base + len(extra)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, ifd) if big else struct.pack("<2sHI", b"II", 42, ifd))
        f.write(b"".join(tiles) + extra + struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + struct.pack(order + word, 0))


@pytest.mark.parametrize(("kind", "compression", "predictor", "big"), [("u2", 1, 1, False), ("i2", 8, 2, False), ("f4", 8, 3, True), ("f4", 8, 1, False), ("u1", 5, 1, False), ("u2", 5, 2, True)])
def test_tiled_tiff_round_trip(spark, tmp_path, kind, compression, predictor, big):
    z = np.random.default_rng(3).integers(1, 200, (40, 37)).astype(float)
    z[3, 4] = 250
    path = str(tmp_path / "a.tif")
    write_tiff(path, z, kind, compression, predictor, big=big, nodata="250")
    got = cog.read_tiled(spark, path, window=(10, 5, 20, 30)).collect()
    assert len(got) == 600 and all(r["value"] == z[r["y"], r["x"]] for r in got)
    level = cog.levels(path)[0]
    assert cog.georeference(level) == (1000.0, 2000.0, 30.0, 30.0)
    assert [r["value"] for r in cog.read_tiled(spark, path, window=(4, 3, 1, 1)).collect()] == [None]


def test_window_prunes_tiles(tmp_path):
    path = str(tmp_path / "b.tif")
    write_tiff(path, np.ones((64, 64)), "u2", 1, 1)
    assert len(cog.TiledTiffReader({"path": path, "window": "0,0,16,16"}).partitions()) == 1


def test_projected_window_bends():
    lcc = geodesy.Lcc()
    x0, y0, w, h = cog.projected_window(lambda lon, lat: (lon * 1000.0, lat * 1000.0), (1, 1, 2, 3), (0.0, 5000.0, 10.0, 10.0), 0.0)
    assert (x0, y0, w, h) == (100, 200, 100, 200) and lcc


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME": " a ", "n": 3, "none": None, "empty": ""}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 6]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "coordinates": []}},
    ]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    rows = vector_io.read_geojson(spark, str(tmp_path / "f.json")).orderBy("fid").collect()
    assert [(r["kind"], r["part"]) for r in rows] == [("poly", 0), ("line", 0), ("line", 1), ("point", 0)]
    assert rows[0]["props"] == {"NAME": "a", "n": "3"} and rows[3]["pts"][0]["lat"] == 6.0


def test_elements_names_daily(spark, tmp_path):
    square = [{"lat": a, "lon": b} for a, b in ((0, 0), (0, 1), (1, 1), (0, 0))]
    doc = {"elements": [{"type": "way", "id": 1, "tags": {"natural": "water"}, "geometry": square}, {"type": "way", "id": 2, "tags": {"highway": "track"}, "geometry": square}, {"type": "way", "id": 3, "geometry": square[:1]}, {"type": "node", "id": 4, "lat": 1.0, "lon": 2.0}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    rows = vector_io.read_elements(spark, str(tmp_path / "o.json")).orderBy("fid").collect()
    assert [(r["fid"], r["kind"]) for r in rows] == [(1, "poly"), (2, "line"), (4, "point")] and rows[0]["props"]["osm_id"] == "1"
    (tmp_path / "n.json").write_text(json.dumps({"items": [{"id": "x", "name": " Peak ", "latitude": 1, "longitude": 2, "concise": {"code": "MTN"}}, {"id": "y", "name": "lost"}]}))
    assert [(r["name"], r["code"]) for r in vector_io.read_names(spark, str(tmp_path / "n.json")).collect()] == [("Peak", "MTN")]
    (tmp_path / "d.json").write_text(json.dumps({"daily": {"time": ["2026-09-01", "2026-09-02"], "temperature_2m_max": [1.5, None]}}))
    assert [(str(r["date"]), r["tmax"], r["snow"]) for r in vector_io.read_daily(spark, str(tmp_path / "d.json")).collect()] == [("2026-09-01", 1.5, None), ("2026-09-02", None, None)]


def test_png_and_heights():
    z = np.array([[0.0, 12.34], [np.nan, -99.95]])
    back = export.decode_heights(export.read_png16(export.png16(export.encode_heights(z))))
    assert np.allclose(back, [[0.0, 12.3], [np.nan, -99.9]], equal_nan=True)
    four = np.arange(24).reshape(2, 3, 4)
    assert (export.read_png16(export.png16(four)) == four).all()


def test_exports(spark):
    places = spark.createDataFrame([("A & B", 1.0, 2.0)], "name string, lon double, lat double")
    assert json.loads(export.geojson(places))["features"][0] == {"type": "Feature", "properties": {"name": "A & B"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    rows, tracks = [r.asDict() for r in places.collect()], {"t": [(1.0, 2.0, 3.0)]}
    assert "A &amp; B" in export.gpx(rows, tracks) and "<ele>3.0</ele>" in export.gpx(rows, tracks)
    data = export.kmz(export.kml(rows, tracks, ("i.png", (0, 1, 2, 3))), "i.png", b"x")
    assert zipfile.ZipFile(io.BytesIO(data)).read("i.png") == b"x"


def test_filters_prune_tiles(spark, tmp_path):
    path = str(tmp_path / "f.tif")
    write_tiff(path, np.arange(64 * 64.0).reshape(64, 64), "f4", 1, 1)
    whole = cog.read_tiled(spark, path)
    assert whole.rdd.getNumPartitions() == 16
    part = whole.where("y >= 17 AND y < 30 AND x = 40")
    assert part.rdd.getNumPartitions() == 1
    assert sorted(r["y"] for r in part.collect()) == list(range(17, 30)) and {r["value"] for r in part.collect()} == {y * 64.0 + 40 for y in range(17, 30)}
    assert whole.where("x IN (1, 60)").rdd.getNumPartitions() == 16 and whole.where("y > 47").rdd.getNumPartitions() == 4
    assert whole.where("y > 100").count() == 0 and whole.where("value < 3 AND y + x < 50").count() == 3


def test_strips_round_trip(spark, tmp_path):
    z = np.random.default_rng(2).uniform(-99, 5000, (23, 9)).round(1)
    z[5] = np.nan
    z[20:, 3] = np.nan
    rows = [(y, x, None if np.isnan(z[y, x]) else float(z[y, x])) for y, x in np.ndindex(*z.shape)]
    grid = spark.createDataFrame(rows, "y int, x int, z double").repartition(5)
    path = str(tmp_path / "heights")
    strips.write_strips(grid, path, {"crs": "local", "x0": 1.5, "y0": 2.5, "res": 30.0}, rows=8)
    got = strips.read_strips(spark, path)
    assert {(r["y"], r["x"]): None if r["value"] is None else round(r["value"], 1) for r in got.collect()} == {(y, x): v for y, x, v in rows}
    meta = strips.sidecar(path)
    assert (meta["w"], meta["h"], meta["res"], [s["y"] for s in meta["strips"]]) == (9, 23, 30.0, [0, 8, 16])
    assert got.where("y BETWEEN 9 AND 12").rdd.getNumPartitions() == 1 and got.where("y < 9").rdd.getNumPartitions() == 2 and got.where("y = 99").count() == 0
    with pytest.raises(Exception, match="holds a raster"):
        strips.write_strips(grid, path, {}, rows=8)
    assert sum(f.name.endswith(".png") for f in (tmp_path / "heights").iterdir()) == 3
    strips.write_strips(grid.where("y < 8"), path, {}, rows=4, overwrite=True)
    assert strips.read_strips(spark, path).count() == 72 and sum(f.name.endswith(".png") for f in (tmp_path / "heights").iterdir()) == 2
    bands = [(y, x, y, x + 1, 65535, 0) for y in range(5) for x in range(4)]
    four = spark.createDataFrame(bands, "y int, x int, red int, green int, blue int, nir int")
    strips.write_strips(four, str(tmp_path / "four"), {"zone": 11}, bands=4, rows=2)
    assert sorted(map(tuple, strips.read_strips(spark, str(tmp_path / "four")).collect())) == [(y, x, r or None, g, b, None) for y, x, r, g, b, _ in bands]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(strips.StripRaster)
    good, bad = (0, 1, bytearray(b"x")), (1, 1, None)
    rows = spark.createDataFrame([good, bad], "y int, rows int, png binary").repartition(2, "y")
    with pytest.raises(Exception, match="without an image"):
        rows.write.format("strip_raster").mode("append").option("path", str(tmp_path / "broken")).option("meta", "{}").save()
    assert not (tmp_path / "broken").exists() or not list((tmp_path / "broken").iterdir())


def test_documents_grow_in_number_not_in_size(spark, monkeypatch):
    from ridgeline.plans import source_queries

    monkeypatch.setattr(source_queries, "ITEMS", 50)
    items = spark.range(1000).select(source_queries._item(F.col("id"), F.concat(F.lit('{"i":'), F.col("id").cast("string"), F.lit("}"))))
    path = source_queries._documents(items, 1000, "items", "many")
    docs = [[i["i"] for i in json.loads(r["value"])["items"]] for r in spark.read.text(path).collect()]
    assert len(docs) == 20 and max(map(len, docs)) < 100  # one of sixteen or eight buckets had 62 or 125, and ever more
    assert all(d == sorted(d) for d in docs) and sorted(i for d in docs for i in d) == list(range(1000))
