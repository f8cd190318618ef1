"""Requests of the services that readers take their files from, as text, and files that are fetched only if absent."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence

Box = tuple[float, float, float, float]

#: Tags that map elements are asked for by, as (kind of element, tag).
SELECTORS = (
    ("way", '"highway"'), ("way", '"waterway"'), ("way", '"natural"="water"'), ("node", '"place"'), ("node", '"natural"="peak"'), ("way", '"landuse"'), ("node", '"tourism"'), ("way", '"railway"'), ("way", '"power"="line"'),
    ("way", '"aeroway"'), ("node", '"man_made"="tower"'), ("node", '"amenity"="fuel"'), ("node", '"amenity"="hospital"'), ("way", '"amenity"="hospital"'), ("node", '"barrier"="gate"'), ("node", '"ford"'), ("way", '"bridge"'), ("node", '"mountain_pass"'),
)


def feature_query(layer: str, box: Box) -> str:
    """Address of the features of a layer that meet a box, coordinates to five digits."""
    corners = ",".join(f"{v:g}" for v in box)
    asked = {"geometry": corners, "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects", "outFields": "*", "outSR": "4326", "f": "geojson", "geometryPrecision": "5"}
    return f"{layer}/query?" + "&".join(f"{k}={v}" for k, v in asked.items())


def names_query(service: str, box: Box, most: int = 1000) -> str:
    return f"{service}?bbox={','.join(f'{v:g}' for v in box)}&num={most}"


def elements_query(box: Box, selectors: Sequence[tuple[str, str]] = SELECTORS, seconds: int = 120) -> str:
    """Text that asks for map elements of any of the tags in a box, with tags and shapes."""
    west, south, east, north = box
    where = f"({south:g},{west:g},{north:g},{east:g})"
    return f"[out:json][timeout:{seconds}];(" + "".join(f"{kind}[{tag}]{where};" for kind, tag in selectors) + ");out tags geom;"


def scene_query(collection: str, lon: float, lat: float, start: str, end: str, most_cloud: float, most: int = 200) -> str:
    """Body of a catalogue search: scenes over a place, between two days, with less cloud than a bound."""
    return json.dumps({
        "collections": [collection], "intersects": {"type": "Point", "coordinates": [lon, lat]}, "datetime": f"{start}T00:00:00Z/{end}T23:59:59Z",
        "limit": most, "query": {"eo:cloud_cover": {"lt": most_cloud}},
    })


def first_reply(hosts: Sequence[str], ask: Callable[[str], str], rounds: int = 3, pause: Callable[[float], None] = time.sleep) -> str:
    """The first reply that is an object of JSON: hosts in turn, round by round, pauses of 5, 15 and 25 seconds. The last fault is raised when none replies."""
    fault: Exception = ValueError("no hosts")
    for turn in range(rounds):
        for host in hosts:
            try:
                text = ask(host)
                if text.lstrip().startswith("{"):
                    return text
                fault = ValueError(f"{host} did not reply with JSON")
            except OSError as e:
                fault = e
            pause(5 + 10 * turn)
    raise fault


def fetched(path: str, fetch: Callable[[], bytes], refresh: bool = False) -> str:
    """The path of a file that is fetched if absent. With ``refresh`` it is fetched anew; if that fails, an old file stays and is used."""
    if os.path.exists(path) and not refresh:
        return path
    try:
        content = fetch()
    except OSError:
        if not os.path.exists(path):
            raise
        return path
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)
    return path
