"""Exact overlay of polygons in the plane: a sweep over horizontal slabs between which no two edges cross.

Events of the sweep are the ends of all edges and the points where two of them cross. Between two events the edges that are alive
have one order from left to right; going along it, each edge enters or leaves its polygon (even-odd), which gives the number of
polygons of either side over every stretch. Areas are sums of the trapezoids of the stretches asked for; rings are put together
again from their borders: sides of trapezoids, and the parts of an event's line where only one of the two slabs is asked for.

Polygons are lists of rings, rings are lists of points (the last joins the first); holes and crossings follow even-odd. Results
are exact but for the rounding of crossing points; points nearer than `NEAR` of the extent count as one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np

NEAR = 1e-12
#: Pairs of slab and edge, or of two edges, that are looked at together.
TOGETHER = 1 << 20

#: (covers of side 0, covers of side 1) to the stretches that are wanted.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > 0) | (b > 0)


def intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > 0) & (b > 0)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > 0) & (b == 0)


def edges_of(rings: Sequence, polygon: int = 0, side: int = 0) -> np.ndarray:
    """(x0, y0, x1, y1, polygon, side) of each edge that isn't horizontal, the lower end first."""
    out = []
    for ring in () if rings is None else rings:
        points = () if ring is None else ring
        p = np.array([q if isinstance(q, (tuple, list)) else (q["x"], q["y"]) for q in points if q is not None], dtype=float).reshape(-1, 2)
        out.append(np.concatenate([p, np.roll(p, -1, axis=0)], axis=1))
    e = np.concatenate(out) if out else np.zeros((0, 4))
    e = e[np.isfinite(e).all(1) & (e[:, 1] != e[:, 3])]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return np.concatenate([e, np.full((len(e), 1), float(polygon)), np.full((len(e), 1), float(side))], axis=1)


def _runs(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose counts add up to about `most`."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value from first to last (exclusive) of each row."""
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    e = e[np.argsort(e[:, 1], kind="stable")]
    last = np.searchsorted(e[:, 1], e[:, 3], "left")  # edges that begin before this one ends
    out = [np.zeros(0)]
    low, high = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for part in _runs(last - np.arange(len(e)), TOGETHER):
        i, j = _spread(np.arange(part.start, part.stop) + 1, last[part])
        i += part.start
        near = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[near], j[near]
        px, py, rx, ry = e[i, 0], e[i, 1], e[i, 2] - e[i, 0], e[i, 3] - e[i, 1]
        qx, qy, sx, sy = e[j, 0], e[j, 1], e[j, 2] - e[j, 0], e[j, 3] - e[j, 1]
        cross = rx * sy - ry * sx
        ok = cross != 0
        t = ((qx - px) * sy - (qy - py) * sx)[ok] / cross[ok]
        u = ((qx - px) * ry - (qy - py) * rx)[ok] / cross[ok]
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append((py[ok] + t * ry[ok])[hit])
    return np.concatenate(out)


def _stretches(e: np.ndarray, ys: np.ndarray) -> Iterator[tuple]:
    """(slab, x at its floor, x at its ceiling, covers of side 0, covers of side 1) of the edges alive in each slab, from left to right.

    The covers are those of the stretch to the right of the edge.
    """
    first, last = np.searchsorted(ys, e[:, 1]), np.searchsorted(ys, e[:, 3])
    alive = np.cumsum(np.bincount(first, minlength=len(ys)) - np.bincount(last, minlength=len(ys)))[:-1]
    for part in _runs(alive, TOGETHER):
        some = np.flatnonzero((first < part.stop) & (last > part.start))
        row, slab = _spread(np.maximum(first[some], part.start), np.minimum(last[some], part.stop))
        row = some[row]
        x0, y0, x1, y1 = e[row, 0], e[row, 1], e[row, 2], e[row, 3]
        bottom = np.where(ys[slab] == y0, x0, x0 + (x1 - x0) * ((ys[slab] - y0) / (y1 - y0)))
        top = np.where(ys[slab + 1] == y1, x1, x0 + (x1 - x0) * ((ys[slab + 1] - y0) / (y1 - y0)))
        middle = bottom + top
        order = np.lexsort((middle, e[row, 4], slab))  # along each polygon: in, out, in, ...
        new = np.ones(len(order), dtype=bool)
        new[1:] = (slab[order][1:] != slab[order][:-1]) | (e[row[order], 4][1:] != e[row[order], 4][:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        step = np.empty(len(order), dtype=np.int64)
        step[order] = 1 - 2 * (place % 2)
        order = np.lexsort((middle, slab))
        covers = [np.cumsum(np.where(e[row[order], 5] == side, step[order], 0)) for side in (0, 1)]
        yield slab[order], bottom[order], top[order], *covers


def _events(e: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([e[:, 1], e[:, 3], crossings(e)]))


def area(e: np.ndarray, wanted: Wanted = union) -> float:
    """Area of the stretches wanted, by edges as edges_of() gives them; each polygon has a number of its own."""
    if not len(e):
        return 0.0
    ys, total = _events(e), 0.0
    for slab, bottom, top, a, b in _stretches(e, ys):
        inside = wanted(a[:-1], b[:-1]) & (slab[1:] == slab[:-1])
        width = (bottom[1:] - bottom[:-1] + top[1:] - top[:-1]) / 2
        total += float((width * (ys[slab[1:] + 1] - ys[slab[1:]]))[inside].sum())
    return total


def _snapped(level: np.ndarray, x: np.ndarray, near: float) -> np.ndarray:
    """The number of each point among the different ones of its level."""
    order = np.lexsort((x, level))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (level[order][1:] != level[order][:-1]) | (np.diff(x[order]) > near)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def rings(e: np.ndarray, wanted: Wanted = union) -> list[list[tuple[float, float]]]:
    """The border of the stretches wanted as rings: outer ones against the clock, holes with it."""
    if not len(e):
        return []
    ys = _events(e)
    near = NEAR * max(np.ptp(e[:, [0, 2]]), np.ptp(ys), 1e-300)
    left, right = [], []  # (slab, bottom, top) of the borders of the wanted stretches
    for slab, bottom, top, a, b in _stretches(e, ys):
        now = wanted(a, b)
        before = np.concatenate([[False], now[:-1]])
        for to, hit in ((left, now & ~before), (right, before & ~now)):
            to.append(np.stack([slab[hit], bottom[hit], top[hit]], axis=1))
    left, right = np.concatenate(left), np.concatenate(right)
    # Points of all borders: floors and ceilings of the left ones, then of the right ones.
    level = np.concatenate([left[:, 0], left[:, 0] + 1, right[:, 0], right[:, 0] + 1]).astype(np.int64)
    x = np.concatenate([left[:, 1], left[:, 2], right[:, 1], right[:, 2]])
    point = _snapped(level, x, near)
    n, m = len(left), len(right)
    lf, lc, rf, rc = point[:n], point[n : 2 * n], point[2 * n : 2 * n + m], point[2 * n + m :]
    at = np.zeros((point.max() + 1 if len(point) else 0, 2))
    at[point] = np.stack([x, ys[level]], axis=1)
    # Along a line of events: +1 where a stretch above begins, and the same for the one below.
    up = np.bincount(lf, minlength=len(at)) - np.bincount(rf, minlength=len(at))
    down = np.bincount(lc, minlength=len(at)) - np.bincount(rc, minlength=len(at))
    above, below = np.cumsum(up) > 0, np.cumsum(down) > 0
    k = np.arange(len(at) - 1)
    floor, ceiling = k[above[:-1] & ~below[:-1]], k[below[:-1] & ~above[:-1]]
    tail = np.concatenate([lc, rf, floor, ceiling + 1])
    head = np.concatenate([lf, rc, floor + 1, ceiling])
    return _chained(at, tail[tail != head], head[tail != head])


def _chained(at: np.ndarray, tail: np.ndarray, head: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed walks along the half-edges; where several leave a point, the one that turns most to the left comes next, so that rings only touch."""
    leaving = defaultdict(list)
    for k in np.argsort(head, kind="stable").tolist():
        leaving[int(tail[k])].append(int(head[k]))
    out = []
    for start in list(leaving):
        while leaving[start]:
            here, walk = leaving[start].pop(), [start]
            back = start
            while here != start:
                walk.append(here)
                nexts = leaving[here]
                if len(nexts) > 1:
                    dx, dy = at[here] - at[back]
                    turn = [np.arctan2(dx * (at[c][1] - at[here][1]) - dy * (at[c][0] - at[here][0]), dx * (at[c][0] - at[here][0]) + dy * (at[c][1] - at[here][1])) for c in nexts]
                    nexts.append(nexts.pop(int(np.argmax(turn))))
                back, here = here, nexts.pop()
            ring = straightened(at[walk])
            if len(ring) > 2:
                out.append([(float(a), float(b)) for a, b in ring])
    return out


def straightened(p: np.ndarray) -> np.ndarray:
    """A ring without the points that lie on the line between their neighbours."""
    while len(p) > 2:
        a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        scale = np.abs(a).sum(1) * np.abs(b).sum(1)
        keep = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-11 * scale
        if keep.all():
            return p
        # Of neighbours only every other goes at once, so that a slow bend isn't taken for a line.
        gone = np.flatnonzero(~keep)
        first = np.ones(len(gone), dtype=bool)
        for k in range(1, len(gone)):
            first[k] = not (gone[k] == gone[k - 1] + 1 and first[k - 1])
        p = np.delete(p, gone[first], axis=0)
    return p[:0]


def signed_area(ring: Sequence) -> float:
    p = np.asarray(ring, dtype=float)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)
