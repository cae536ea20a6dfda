"""Hand-checked statistics, and brute force where no closed answer exists."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import tests_of_significance as S
from gridlark.operators import spatial as P
from gridlark.operators import trends as X


def frame(spark, ys, xs=None):
    return spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(xs or range(len(ys)), ys)], "k int, x double, y double")


def test_tau_and_slope(spark):
    r = X.sen(X.series(frame(spark, [1, 3, 2, 2, 5, 7]), ["k"], "x", "y")).first()
    assert r.tau == pytest.approx(0.690066, abs=1e-6)
    r = X.sen(X.series(frame(spark, [1, 3, 2], [1, 2, 3]), ["k"], "x", "y")).first()
    assert r.slope == 0.5
    assert X.sen(X.series(frame(spark, [2, 2, 2]), ["k"], "x", "y")).first().tau is None


def test_tests_match_brute_force(spark):
    for n in (3, 5, 6):
        total = list(itertools.permutations(range(n)))
        s = [sum(np.sign(p[j] - p[i]) for i, j in itertools.combinations(range(n), 2)) for p in total]
        for want in set(s):
            assert S.kendall_two_sided(want, n, [], []) == pytest.approx(np.mean([abs(v) >= abs(want) for v in s]) if want else 1.0)
    # t with 1 and 2 degrees of freedom has closed forms
    for t in (0.3, 1.0, 4.0):
        assert S.t_two_sided(t, 1) == pytest.approx(1 - 2 * np.arctan(t) / np.pi)
        assert S.t_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t))
    got = X.sen_tests(X.series(frame(spark, range(10)), ["k"], "x", "y")).first()
    assert got.tau_p < 1e-5 and got.slope_lo == got.slope_hi == 1


def test_fdr(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.3, 0.9]
    got = X.bh_rejected(spark.createDataFrame([(v,) for v in p], "p double"), "p").orderBy("p").collect()
    assert [r.rejected for r in got] == [True, True] + [False] * 6


def test_field_test(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(40, 8))
    y[0] = 1.0
    y[1] = np.arange(8)
    rows = [(c, float(x), float(y[c, x])) for c in range(40) for x in range(8)]
    df = X.series(spark.createDataFrame(rows, "cell int, x double, y double"), ["cell"], "x", "y")
    cells, field = X.field_test(df.repartition(3), "cell", n_perm=200)
    got = {r.cell: r for r in cells.collect()}
    x, orders = np.arange(8), X.shuffles(range(8), 200)
    assert sorted(orders[0]) == list(range(8)) and len({tuple(o) for o in orders}) > 190
    rho = lambda v, order: float(spearman(v, x[order]))
    spearman = lambda v, w: np.corrcoef([(v < i).sum() + (v <= i).sum() for i in v], w)[0, 1]
    live, sig, up = [], [], []
    for c in range(40):
        if len(set(y[c])) == 1:
            assert not got[c].live and got[c].p_cell is None and got[c].rho is None
            continue
        scores = np.round([rho(y[c], range(8)), *(rho(y[c], o) for o in orders)], 9)
        assert got[c].rho == pytest.approx(scores[0], abs=1e-8)
        assert got[c].p_cell == pytest.approx((1 + (abs(scores[1:]) >= abs(scores[0])).sum()) / 201)
        sig.append(abs(scores) >= np.quantile(abs(scores[1:]), 0.95) - 1e-9)
        up.append(scores > 0)
    share, ups = np.mean(sig, axis=0), np.mean(up, axis=0)
    f = field.first()
    assert f.n_cells == 39 and f.significant == pytest.approx(share[0]) and f.up == pytest.approx(ups[0])
    assert f.significant_p == pytest.approx((1 + (share[1:] >= share[0]).sum()) / 201)
    assert f.up_p == pytest.approx((1 + (ups[1:] >= ups[0]).sum()) / 201)
    assert f.null_significant_p95 == pytest.approx(np.quantile(share[1:], 0.95))
    with pytest.raises(ValueError):
        X.field_test(df.unionByName(df.select("cell", F.expr("slice(pts, 1, 7)").alias("pts"))), "cell", n_perm=10)


def test_ranked_values(spark):
    values = [None if k % 13 == 0 else float(k * k % 97) for k in range(3000)] + [5.0] * 2000
    got = {r.v: (r.n, r.upto) for r in X.ranked_values(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    some = sorted(v for v in values if v is not None)
    assert got == {v: (some.count(v), sum(w <= v for w in some)) for v in set(some)}


def test_correlations_and_trend(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (None, 3.0), (float("nan"), 1.0)], "a double, b double")
    assert X.correlations(df, "a", "b").first().asDict() == {"n": 2, "pearson_r": None, "spearman_r": None, "log_pearson_r": None}
    t = X.log_trend(frame(spark, [np.exp(0.1 * k) for k in range(6)]), ["k"], "x", "y").first()
    assert t.percent_per_year == pytest.approx(10) and t.factor == pytest.approx(np.exp(0.5))


def test_polygons(spark):
    l_shape = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in l_shape])
    shapes = spark.range(1).select(F.col("id").alias("shape"), F.array(ring).alias("rings"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0), (3, 0.5, 3.5), (4, 4.0, 0.5), (5, 9.0, 9.0)], "id int, x double, y double")
    assert {r.id for r in P.point_in_polygon(pts, shapes, 1.0, edge=True).collect()} == {1, 3, 4}
    assert {r.id for r in P.point_in_polygon(pts, shapes, 1.0, edge=False).collect()} == {1, 3}
    assert shapes.select(P.shoelace_area("rings[0]")).first()[0] == 7


def test_smoothing_keeps_constants(spark):
    cells = spark.range(25).select((F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.when(F.col("id") != 12, 3.0).alias("v"))
    got = P.smoothed(cells, "v", 1.0, 2).collect()
    assert got and all(r.smooth == pytest.approx(3.0) for r in got)


def slow_smooth(values, sigma, reach, least):
    """The whole stencil at every cell."""
    one = {k: math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
    total = sum(one.values())
    out = {}
    for r, c in values:
        near = [(one[i] * one[j] / total**2, values[r + i, c + j]) for i in one for j in one if values.get((r + i, c + j)) is not None]
        weight = sum(w for w, _ in near)
        if weight > least:
            out[r, c] = (sum(w * v for w, v in near) / weight, weight)
    return out


@pytest.mark.parametrize("tile", [3, 7, 256])
def test_smoothing_by_tiles(spark, tile):
    rng = random.Random(tile)
    values = {(r, c): rng.random() * 9 if rng.random() < 0.6 else None for r in range(-4, 17) for c in range(30) if rng.random() < 0.9}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], "row int, col int, v double")
    got = {(r.row, r.col): (r.smooth, r.weight) for r in P.smoothed(cells, "v", 1.3, 4, 0.35, tile).collect()}
    want = slow_smooth(values, 1.3, 4, 0.35)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert P.smoothed(cells.where("1 = 0"), "v", 1.3, 4).count() == 0
