"""Whole-grid algorithms that the tiled operators are held against."""

import heapq
import math

import numpy as np

from ridgeline.operators.flood import STEPS_8
from ridgeline.operators.rays import curvature_drop, ray_steps
from ridgeline.operators.walks import LENGTHS, MOVES, tobler_speed


def drainage(z: np.ndarray, cell: np.ndarray, lift: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filled heights, downstream cell (-1 at outlets) and upstream area in km2.

    Priority flood from the border: a cell is filled to just above the cell it was reached from. Where nothing was filled the water takes the steepest
    way down instead; elsewhere it follows the flood back.
    """
    h, w = z.shape
    size = np.broadcast_to(np.asarray(cell, float), h)
    filled, down, seen = z.astype(float).copy(), np.full(h * w, -1, np.int64), np.zeros(h * w, bool)
    flat = filled.ravel()
    border = [i for i in range(h * w) if i // w in (0, h - 1) or i % w in (0, w - 1)]
    heap = [(float(flat[i]), i) for i in border]
    heapq.heapify(heap)
    seen[border] = True
    while heap:
        level, i = heapq.heappop(heap)
        y, x = divmod(i, w)
        for dy, dx in STEPS_8:
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w and not seen[v * w + u]:
                j = v * w + u
                seen[j] = True
                flat[j] = max(float(flat[j]), level + lift)
                down[j] = i
                heapq.heappush(heap, (float(flat[j]), j))
    pad = np.pad(z.astype(float), 1, constant_values=np.inf)
    drops = np.stack([(z - pad[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]) / (size[:, None] * math.hypot(dy, dx)) for dy, dx in STEPS_8])
    best = drops.argmax(0)  # the first in row-major order
    yy, xx = np.indices(z.shape)
    step = np.array(STEPS_8)[best]
    steep = ((yy + step[..., 0]) * w + xx + step[..., 1]).ravel()
    free = (np.abs(flat - z.ravel()) < 0.01) & (drops.max(0).ravel() > 0)
    down = np.where(free, steep, down)
    area = np.repeat(size * size / 1e6, w)
    for i in np.lexsort((np.arange(h * w), -flat)):
        if down[i] >= 0:
            area[down[i]] += area[i]
    return filled, down.reshape(h, w), area.reshape(h, w)


def streams(down: np.ndarray, area: np.ndarray, threshold: float) -> list[tuple[list[int], float]]:
    """Reaches: cells from a head or confluence down to the next confluence, outlet or cell that is no channel, and the area at the lower end."""
    flat, size = down.ravel(), area.ravel()
    channel = size >= threshold
    inflow = np.bincount(flat[channel & (flat >= 0) & channel[flat]], minlength=len(flat))
    out = []
    for i in np.flatnonzero(channel & (inflow != 1)):
        cells, j = [int(i)], int(flat[i])
        while j >= 0:
            cells.append(j)
            if inflow[j] != 1:
                break
            j = int(flat[j])
        if len(cells) > 1:
            out.append((cells, float(size[cells[-1]])))
    return out


def summits(z: np.ndarray, least: float) -> list[tuple[int, int, float, float, int, int, bool]]:
    """(y, x, height, prominence, saddle y, saddle x, edge) by prominence: cells surface from the highest, islands meet at saddles.

    Where islands meet, the one with the highest top goes on. An island that touches the border before it ends is an edge peak with the least prominence that
    the grid allows; its saddle is unknown (-1).
    """
    h, w = z.shape
    flat = z.ravel()
    parent = np.full(h * w, -1, np.int64)
    top, edge = {}, {}
    out = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def tell(r: int, at: int, on_edge: bool) -> None:
        t = top[r]
        rise = float(flat[t] - flat[at])
        if rise >= least:
            out.append((t // w, t % w, float(flat[t]), rise, -1 if on_edge else at // w, -1 if on_edge else at % w, on_edge))

    for i in np.lexsort((np.arange(h * w), -flat)):
        i = int(i)
        if flat[i] != flat[i]:
            continue
        y, x = divmod(i, w)
        found = sorted({root(v * w + u) for dy, dx in STEPS_8 if 0 <= (v := y + dy) < h and 0 <= (u := x + dx) < w and parent[v * w + u] >= 0}, key=lambda r: (-flat[top[r]], top[r]))
        border = y in (0, h - 1) or x in (0, w - 1)
        if not found:
            parent[i], top[i], edge[i] = i, i, False
            keep = i
        else:
            keep = found[0]
            for r in found[1:]:
                if not edge[r]:
                    tell(r, i, False)
                parent[r] = keep
                edge[keep] = edge[keep] or edge[r]
            parent[i] = keep
        if border and not edge[keep]:
            edge[keep] = True
            tell(keep, i, True)
    return sorted(out, key=lambda p: (-p[3], p[0], p[1]))


def travel_time(z: np.ndarray, factor: np.ndarray, cell: np.ndarray, start: tuple[int, int], reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hours from a start (or to it) and the cell before, by Dijkstra over 16 moves; unreachable cells are infinite and -1.

    The run of a move is its length times the cell size of the row it leaves; moves whose mean factor isn't positive are barred.
    """
    h, w = z.shape
    hours, before = np.full(h * w, np.inf), np.full(h * w, -1, np.int64)
    heights, speed, size = z.ravel().tolist(), factor.ravel().tolist(), np.broadcast_to(cell, h).tolist()
    moves = [(dy, dx, LENGTHS[dy * dy + dx * dx]) for dy, dx in MOVES]
    first = start[0] * w + start[1]
    hours[first] = 0.0
    best = hours.tolist()
    heap = [(0.0, first)]
    while heap:
        t, i = heapq.heappop(heap)
        if t > best[i]:
            continue
        y, x = divmod(i, w)
        for dy, dx, length in moves:
            v, u = y + dy, x + dx
            if not (0 <= v < h and 0 <= u < w):
                continue
            j = v * w + u
            mean = (speed[i] + speed[j]) / 2
            if not mean > 0 or heights[j] != heights[j]:
                continue
            run = length * size[y]
            rise = (heights[i] - heights[j] if reverse else heights[j] - heights[i]) / run
            after = t + run / 1000 / (tobler_speed(rise) * mean)
            if after < best[j]:
                best[j] = after
                before[j] = i
                heapq.heappush(heap, (after, j))
    return np.array(best).reshape(h, w), before.reshape(h, w)


def path_to(before: np.ndarray, end: tuple[int, int]) -> list[tuple[int, int]]:
    """The cells from the start to ``end``; empty if there is no way."""
    w = before.shape[1]
    out, i = [end], int(before[end])
    while i >= 0:
        out.append(divmod(i, w))
        i = int(before[divmod(i, w)])
    return out[::-1] if len(out) > 1 else []


def bilinear(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = z.shape
    x, y = np.clip(x, 0, w - 1.001), np.clip(y, 0, h - 1.001)
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - i, y - j
    return (z[j, i] * (1 - fx) + z[j, i + 1] * fx) * (1 - fy) + (z[j + 1, i] * (1 - fx) + z[j + 1, i + 1] * fx) * fy


def visible(z: np.ndarray, ox: float, oy: float, tx: np.ndarray, ty: np.ndarray, cell: float, eye: float, target: float) -> np.ndarray:
    """Which targets an eye sees: one sample per cell of distance, all targets of a batch at once."""
    far = np.hypot(tx - ox, ty - oy)
    start = z[int(oy), int(ox)] + eye
    aim = z[ty.astype(int), tx.astype(int)] + target - curvature_drop(far * cell) - start
    seen = np.ones(len(tx), bool)
    n = np.ceil(far).astype(int)
    for s in range(1, int(n.max(initial=0))):
        live = np.flatnonzero(seen & (s < n) & (far >= 1.5))
        if not len(live):
            break
        f = s / n[live]
        ground = bilinear(z, ox + (tx[live] - ox) * f, oy + (ty[live] - oy) * f)
        seen[live[ground - curvature_drop(far[live] * f * cell) > start + aim[live] * f]] = False
    return seen


def sunlit(z, normals, sun, cell):
    """first, last and number of samples lit of each cell, as arrays; nan where never."""
    h, w = z.shape
    yy, xx = np.indices(z.shape)
    x, y, z0 = xx.ravel().astype(float), yy.ravel().astype(float), z.ravel()
    first, last, n = np.full(z.size, np.nan), np.full(z.size, np.nan), np.zeros(z.size)
    for hour, azimuth, altitude in sun:
        az, al = math.radians(azimuth), math.radians(altitude)
        east, north, rise = math.sin(az), math.cos(az), math.tan(al)
        nx, ny, nz = normals
        lit = nx * east * math.cos(al) + ny * north * math.cos(al) + nz * math.sin(al) > 0
        for d in ray_steps(math.hypot(h, w)):
            px, py = x + east * d, y - north * d
            beam = z0 + 1 + d * cell * rise + curvature_drop(d * cell)
            on = (px >= 0) & (py >= 0) & (px <= w - 1) & (py <= h - 1) & (beam <= np.nanmax(z))
            ground = bilinear(z, np.where(on, px, 0), np.where(on, py, 0))
            lit &= ~(on & (ground > beam))
        first = np.where(lit & np.isnan(first), hour, first)
        last = np.where(lit, hour, last)
        n += lit
    return first, last, n
