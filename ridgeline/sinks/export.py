"""Result files: GPX, GeoJSON, KML and KMZ of places and tracks, 16-bit PNG grids and manifests.

Places and tracks are results of bounded size. GeoJSON features are built per row by Spark and may be written in parts.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(places: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One JSON text per row: a point feature with the other columns as properties."""
    props = F.struct(*(F.col(c) for c in places.columns if c not in (lon, lat)))
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return places.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), point.alias("geometry"))).alias("value"))


def geojson(places: DataFrame) -> str:
    return '{"type":"FeatureCollection","features":[' + ",".join(r["value"] for r in geojson_features(places).collect()) + "]}"


def gpx(places: list, tracks: dict[str, list[tuple[float, float, float | None]]], creator: str = "ridgeline") -> str:
    """Waypoints (rows with lon, lat, name, and perhaps note) and tracks of (lon, lat, height)."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<gpx version="1.1" creator="{escape(creator)}" xmlns="http://www.topografix.com/GPX/1/1">']
    for p in places:
        note = p["note"] if "note" in p else None
        out.append(f'<wpt lat="{p["lat"]:.6f}" lon="{p["lon"]:.6f}"><name>{escape(p["name"])}</name>' + (f"<desc>{escape(note)}</desc>" if note else "") + "</wpt>")
    for name, points in tracks.items():
        out.append(f"<trk><name>{escape(name)}</name><trkseg>")
        out += [f'<trkpt lat="{lat:.6f}" lon="{lon:.6f}">' + ("" if z is None else f"<ele>{z:.1f}</ele>") + "</trkpt>" for lon, lat, z in points]
        out.append("</trkseg></trk>")
    return "\n".join([*out, "</gpx>"])


def kml(places: list, tracks: dict[str, list[tuple[float, float, float | None]]], overlay: tuple[str, tuple[float, float, float, float]] | None = None) -> str:
    """Placemarks and lines; perhaps an image over a box (west, south, east, north)."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>']
    if overlay:
        href, (west, south, east, north) = overlay
        out.append(f"<GroundOverlay><Icon><href>{escape(href)}</href></Icon><LatLonBox><north>{north}</north><south>{south}</south><east>{east}</east><west>{west}</west></LatLonBox></GroundOverlay>")
    out += [f'<Placemark><name>{escape(p["name"])}</name><Point><coordinates>{p["lon"]:.6f},{p["lat"]:.6f}</coordinates></Point></Placemark>' for p in places]
    for name, points in tracks.items():
        line = " ".join(f"{lon:.6f},{lat:.6f}" + ("" if z is None else f",{z:.1f}") for lon, lat, z in points)
        out.append(f"<Placemark><name>{escape(name)}</name><LineString><tessellate>1</tessellate><coordinates>{line}</coordinates></LineString></Placemark>")
    return "\n".join([*out, "</Document></kml>"])


def kmz(document: str, image_name: str | None = None, image: bytes = b"") -> bytes:
    """A zip of the document, deflated, and an image, stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("doc.kml", document, zipfile.ZIP_DEFLATED)
        if image_name:
            z.writestr(image_name, image, zipfile.ZIP_STORED)
    return out.getvalue()


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png16(values: np.ndarray) -> bytes:
    """Grey 16-bit PNG of an array of rows; three dimensions of four bands give RGBA."""
    rows = values.astype(">u2").reshape(values.shape[0], -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", values.shape[1], values.shape[0], 16, 6 if values.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def read_png16(data: bytes) -> np.ndarray:
    """What png16 has written, and other 16-bit PNG files without interlacing."""
    at, body, head = 8, b"", b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        piece = data[at + 8 : at + 8 + size]
        head, body = (piece if kind == b"IHDR" else head), (body + piece if kind == b"IDAT" else body)
        at += size + 12
    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", head)
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 16 or lace:
        raise ValueError("16-bit PNG without interlacing is asked for")
    step, raw = 2 * bands, zlib.decompress(body)
    out, last = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y in range(h):
        start = y * (w * step + 1)
        kind, line = raw[start], np.frombuffer(raw, np.uint8, w * step, start + 1).copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            line = line + last
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b, c = (int(line[i - step]) if i >= step else 0), int(last[i]), (int(last[i - step]) if i >= step else 0)
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v, p=a + b - c, o=(a, b, c): (abs(p - v), o.index(v)))
                line[i] = (int(line[i]) + guess) & 255
        out[y] = last = line
    values = out.view(">u2").reshape(h, w, bands).astype(np.uint16)
    return values[:, :, 0] if bands == 1 else values


def encode_heights(z: np.ndarray) -> np.ndarray:
    """Tenths of metres over -100; 0 is missing. Values below -99.9 are held there, as the format has no place for them."""
    return np.where(np.isnan(z), 0, np.clip(np.round((np.nan_to_num(z) + 100) * 10), 1, 65535)).astype(np.uint16)


def decode_heights(raw: np.ndarray) -> np.ndarray:
    return np.where(raw == 0, np.nan, raw / 10.0 - 100)


def grid_manifest(name: str, box: tuple[float, float, float, float], width: int, height: int, channels: dict[str, str]) -> str:
    return json.dumps({"name": name, "box": box, "width": width, "height": height, "channels": channels}, sort_keys=True)
