"""Exact overlays against brute force: point tests, trapezoid sums and cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import overlay as O
from gridlark.functions.grid import Albers
from gridlark.operators import overlays as V

SHAPE = f"shape long, day long, kind string, rings {V.RINGS}"


def star(rng, n, cx, cy, r):
    """A ring that is concave nearly everywhere; it may cross itself when shifted."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(cx + d * math.cos(t), cy + d * math.sin(t)) for t in turns for d in [r * (0.3 + 0.7 * rng.random())]]


def covers(polygons, points):
    """How many polygons hold each point, by casting a ray against every edge."""
    out = np.zeros(len(points), dtype=int)
    for rings in polygons:
        odd = np.zeros(len(points), dtype=int)
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]]):
                if y0 != y1:
                    odd += ((y0 > points[:, 1]) != (y1 > points[:, 1])) & (points[:, 0] < (x1 - x0) * (points[:, 1] - y0) / (y1 - y0) + x0)
        out += odd % 2
    return out


def slow_area(a, b, wanted):
    """Trapezoid sum between all ends and all crossings of any two edges, one height and one edge at a time."""
    edges = [(p, q, (s, k)) for s, side in enumerate((a, b)) for k, rings in enumerate(side) for r in rings for p, q in zip(r, [*r[1:], r[0]]) if p[1] != q[1]]
    ys = {p[1] for e in edges for p in e[:2]}
    for i, (p, q, _) in enumerate(edges):
        for r, s, _ in edges[:i]:
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 <= t <= 1:
                    ys.add(p[1] + t * (q[1] - p[1]))
    ys, total = sorted(ys), 0.0
    for low, high in zip(ys, ys[1:]):
        alive = []
        for p, q, owner in edges:
            if min(p[1], q[1]) <= low and max(p[1], q[1]) >= high:
                x = [p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) for y in (low, high)]
                alive.append((sum(x), x, owner))
        alive.sort(key=lambda v: v[0])
        inside = set()
        for (_, x, owner), (_, z, _) in zip(alive, alive[1:]):
            inside ^= {owner}
            n = [np.array([sum(s == side for s, _ in inside)]) for side in (0, 1)]
            if wanted(*n)[0]:
                total += (z[0] - x[0] + z[1] - x[1]) / 2 * (high - low)
    return total


def stacked(a, b):
    return np.concatenate([O.edges_of(r, 2 * k + s, s) for s, side in enumerate((a, b)) for k, r in enumerate(side)])


@pytest.mark.parametrize("seed", range(12))
def test_overlay_by_brute_force(seed):
    """Random concave rings with holes: areas to 1e-9, rings by points; the rings' own areas agree with the sum of trapezoids."""
    rng = random.Random(seed)
    a = [[star(rng, rng.randrange(3, 18), rng.random() * 2, rng.random() * 2, 1.0)] + [star(rng, 5, 1, 1, 0.2)] * rng.randrange(2) for _ in range(rng.randrange(1, 4))]
    b = [[star(rng, rng.randrange(3, 18), rng.random() * 2, rng.random() * 2, 1.0)] for _ in range(rng.randrange(1, 3))]
    points = np.array([(rng.random() * 5 - 1.5, rng.random() * 5 - 1.5) for _ in range(1500)])
    for wanted in (O.union, O.intersection, O.difference):
        e = stacked(a, b)
        area, rings = O.area(e, wanted), O.rings(e, wanted)
        assert area == pytest.approx(slow_area(a, b, wanted), abs=1e-9)
        assert sum(map(O.signed_area, rings)) == pytest.approx(area, abs=1e-9)
        assert (covers([rings], points) == wanted(covers(a, points), covers(b, points))).all()


def test_overlay_of_touching_and_equal_shapes():
    square = lambda x, y, s=1.0: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    e = stacked([square(0, 0), square(1, 0), square(0, 1), square(0, 0)], [])
    assert O.area(e) == 3 and len(O.rings(e)) == 1 and len(O.rings(e)[0]) == 6
    assert O.area(stacked([square(0, 0)], [square(1, 0)]), O.intersection) == 0 == len(O.rings(stacked([square(0, 0)], [square(1, 0)]), O.intersection))
    corner = O.rings(stacked([square(0, 0), square(1, 1)], []))
    assert sorted(map(len, corner)) == [4, 4]
    hole = O.rings(stacked([square(0, 0, 3.0)], [square(1, 1)]), O.difference)
    assert sorted(map(O.signed_area, hole)) == [-1, 9]
    assert O.rings(O.edges_of([])) == [] and O.area(O.edges_of([[(0, 0), (1, 1)]])) == 0
    assert O.area(O.edges_of([[(0, 0), (1, 1), (1, 0), (0, 1)]])) == 0.5


def rows(rng, n, wide):
    out = []
    for k in range(n):
        rings = [star(rng, rng.randrange(3, 12), rng.random() * wide, rng.random() * wide, 1.5)]
        out.append((k, k % 3, rng.choice(["light", "heavy", "other"]), rings))
    return out


def frame(spark, found):
    return spark.createDataFrame([(k, d, c, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, d, c, rings in found], SHAPE)


def test_areas_by_strips(spark):
    """Strips of any height agree with the whole day in one sweep, with and without a domain."""
    found = rows(random.Random(1), 40, 8)
    shapes = frame(spark, found)
    domain = [[[(1.0, 0.5), (7.0, 1.0), (6.0, 7.0), (2.0, 6.0)], [(3.0, 3.0), (4.0, 3.0), (4.0, 4.0)]]]
    area = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in r] for r in domain[0]])], f"d long, domain_rings {V.RINGS}")
    for height in (0.3, 2.0, 100.0):
        for side in ([], domain):
            wanted = O.intersection if side else O.union
            got = {r["day"]: r["area"] for r in V.union_area(shapes, ["day"], "shape", height, area if side else None).collect()}
            for day in range(3):
                mine = [rings for _, d, _, rings in found if d == day]
                assert got[day] == pytest.approx(O.area(stacked(mine, side), wanted), abs=1e-9)
    classes = {(r["day"], r["class"]): (r["area"], r["shapes"]) for r in V.class_areas(shapes.where("not (day = 1 and kind = 'heavy')"), "day", "kind", ["light", "heavy"], "shape", 1.0).collect()}
    assert len(classes) == 9 and classes[1, "heavy"] == (0.0, 0)
    light = [rings for _, d, c, rings in found if d == 0 and c == "light"]
    assert classes[0, "light"] == (pytest.approx(O.area(stacked(light, []))), len(light))


def test_clips_of_pairs(spark):
    found = rows(random.Random(2), 20, 6)
    domain = rows(random.Random(3), 6, 6)
    b = frame(spark, domain).select(F.col("shape").alias("part"), F.col("rings").alias("domain_rings"))
    for size in (0.7, 50.0):
        got = {(r["shape"], r["part"]): r["area"] for r in V.clipped(frame(spark, found), b, size).collect()}
        want = {(k, j): O.area(stacked([p], [q]), O.intersection) for k, _, _, p in found for j, _, _, q in domain}
        assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-9)


def test_repaired(spark):
    bow = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]
    found = [(1, 0, "", bow), (2, 0, "", [[(0.0, 0.0), (1.0, 1.0)]]), (3, 0, "", []), (4, 0, "", [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]])]
    got = {r["shape"]: r for r in V.repaired(frame(spark, found)).withColumn("a", V.ring_area("rings")).collect()}
    assert sorted(got) == [1, 4]
    assert got[1]["a"] == pytest.approx(2) and sorted(map(len, got[1]["rings"])) == [3, 3] and got[4]["a"] == pytest.approx(8.5)


def test_mapped(spark):
    x = spark.createDataFrame([([[{"x": -75.0, "y": 35.0}]],)], f"rings {V.RINGS}").select(V.mapped("rings", Albers(6378206.4, 0.00676866).forward)).first()[0][0][0]
    assert (x["x"], x["y"]) == (pytest.approx(1885472.7, abs=0.2), pytest.approx(1535925.0, abs=0.2))


def squares(rng, wide, share):
    return {(x, y) for x in range(wide) for y in range(wide) if rng.random() < share}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9, 1.0])
def test_dissolved_squares(spark, share):
    """Unit squares of two keys: rings cover the same cells, hold no inner edge, and there are as many as parts and holes."""
    rng = random.Random(int(share * 10))
    cells = {d: squares(rng, 9, share) for d in (0, 1)}
    found = [(100 * x + y, d, "", [[(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0)][:: rng.choice([1, -1])]]) for d in cells for x, y in cells[d]]
    got = V.dissolved(frame(spark, found), ["day"]).collect()
    for d, have in cells.items():
        mine = [[(p["x"], p["y"]) for p in r["points"]] for r in got if r["day"] == d]
        assert sum(r["area"] for r in got if r["day"] == d) == len(have)
        assert sum(map(len, mine)) == sum((x + i, y + j) not in have for x, y in have for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for r in mine for a, b in zip(r, [*r[1:], r[0]]))
        middle = np.array([(x + 0.5, y + 0.5) for x in range(-1, 10) for y in range(-1, 10)])
        assert (covers([mine], middle) == [((x - 0.5, y - 0.5) in have) for x, y in middle]).all()

        def parts(cells, steps):
            cells, n = set(cells), 0
            while cells:
                todo, n = [cells.pop()], n + 1
                while todo:
                    x, y = todo.pop()
                    for i, j in steps:
                        if (x + i, y + j) in cells:
                            cells.remove((x + i, y + j))
                            todo.append((x + i, y + j))
            return n

        four, eight = [(1, 0), (-1, 0), (0, 1), (0, -1)], [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        empty = {(x, y) for x in range(-1, 10) for y in range(-1, 10)} - have
        assert sum(r["area"] > 0 for r in got if r["day"] == d) == parts(have, four)
        assert sum(r["area"] < 0 for r in got if r["day"] == d) == parts(empty, eight) - 1


def test_dissolved_long_ring_and_expected_number(spark):
    n = 600
    circle = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    wedges = [(k, 0, "", [[(0.0, 0.0), circle[k], circle[(k + 1) % n]]]) for k in range(n)]
    got = V.dissolved(V.expected(frame(spark, wedges), n), ["day"]).collect()
    assert len(got) == 1 and len(got[0]["points"]) == n and got[0]["area"] == pytest.approx(n / 2 * math.sin(2 * math.pi / n))
    assert V.dissolved(frame(spark, wedges).where("1 = 0"), ["day"]).count() == 0
    with pytest.raises(Exception, match="unexpected number of rows: 600"):
        V.expected(frame(spark, wedges), 49).count()
