"""Plans of trends, significance, decomposition and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import grid as G
from gridlark.functions.tests_of_significance import inversions
from gridlark.operators import daily as D
from gridlark.operators import spatial as S
from gridlark.operators import tables as T
from gridlark.operators import trends as X
from gridlark.plans.archive import FIRST, LAST, SPAN
from gridlark.plans.inputs import CUBE, YEARLY, cube, r6, rounded, table, yearly_cells


def _series(spark, sf_dir):
    return X.series(yearly_cells(spark, sf_dir), ["cell"], "year", "v")


def sen_slope(spark, sf_dir):
    return rounded(X.sen(_series(spark, sf_dir)).select("cell", "slope", "intercept", "n"), "slope", "intercept")


def sen_slope_join(spark, sf_dir):
    return rounded(X.pair_slopes_join(yearly_cells(spark, sf_dir), ["cell"], "year", "v"), "slope")


def kendall_tau(spark, sf_dir):
    return rounded(X.sen(_series(spark, sf_dir)).select("cell", "tau"), "tau")


def sen_with_tests(spark, sf_dir):
    return rounded(X.sen_tests(_series(spark, sf_dir)).select("cell", "slope", "slope_lo", "slope_hi", "tau", "tau_p"), "slope", "slope_lo", "slope_hi", "tau", "tau_p")


def spearman_time(spark, sf_dir):
    return rounded(X.spearman_with_x(yearly_cells(spark, sf_dir), ["cell"], "year", "v"), "rho")


def log_trend(spark, sf_dir):
    return rounded(X.log_trend(yearly_cells(spark, sf_dir), ["cell"], "year", "v"), "percent_per_year", "percent_lo", "percent_hi", "factor", "tau", "tau_p")


def _annual(spark, sf_dir):
    return T.series_ratios(cube(spark, sf_dir).where(F.col("year").between(FIRST, LAST)), ["year"])


def growth_decomposition(spark, sf_dir):
    """Growth of the index as growth of frequency and of intensity, with what is left over, and the background's."""
    a = _annual(spark, sf_dir)
    long = a.select("year", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in ("fraction", "intensity", "flag_index", "mean_value", "background")])).alias("s")).select("year", "s.*")
    rate = X.log_trend(long, ["series"], "year", "v").select("series", "percent_per_year")
    wide = rate.groupBy().pivot("series", ["fraction", "intensity", "flag_index", "mean_value", "background"]).agg(F.first("percent_per_year"))
    total = F.col("fraction") + F.col("intensity")
    return wide.select(
        *[r6(c).alias(c) for c in ("fraction", "intensity", "flag_index", "mean_value", "background")],
        r6(total).alias("total"), r6(F.col("flag_index") - total).alias("residual"), r6(F.col("fraction") / total).alias("fraction_share"),
    )


def ols(spark, sf_dir):
    return rounded(X.ols(yearly_cells(spark, sf_dir), ["cell"], "year", "v").select("cell", "slope", "intercept", "r2", "n"), "slope", "intercept", "r2")


def ols_p(spark, sf_dir):
    return rounded(X.ols(yearly_cells(spark, sf_dir), ["cell"], "year", "v").select("cell", "p"), "p")


def _pairs(spark, sf_dir):
    m = T.series_ratios(cube(spark, sf_dir), ["year", "month"])
    return m.select("b", F.when(F.col("month") % 4 != 0, F.col("d")).alias("d"))


def correlations(spark, sf_dir):
    return rounded(X.correlations(_pairs(spark, sf_dir), "b", "d"), "pearson_r", "spearman_r", "log_pearson_r")


def correlations_p(spark, sf_dir):
    got = X.correlations(_pairs(spark, sf_dir), "b", "d")
    return rounded(X.with_p(X.with_p(got, "pearson_r", "n", "pearson_p"), "spearman_r", "n", "spearman_p").select("n", "pearson_p", "spearman_p"), "pearson_p", "spearman_p")


def bh_fdr(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.pow((F.col("c_custkey") % 997) / F.lit(997.0), F.lit(3))).alias("p"))
    return X.bh_rejected(p, "p").select("c_custkey", "rejected")


def field_cells(spark, sf_dir):
    return rounded(X.field_test(_series(spark, sf_dir), "cell")[0], "rho", "p_cell")


def field_test(spark, sf_dir):
    return rounded(X.field_test(_series(spark, sf_dir), "cell")[1], "significant", "up", "null_significant_p95", "significant_p", "null_up_p95", "up_p")


def spatial_summary(spark, sf_dir):
    """Shares of cells with rising and with significant trends, raw and after false-discovery control, and slope quantiles."""
    t = X.bh_rejected(X.sen_tests(_series(spark, sf_dir)), "tau_p")
    share = lambda c: r6(F.avg(c.cast("double")))
    up, raw = F.col("tau") > 0, F.col("tau_p") < 0.05
    return t.agg(F.count("*").alias("cells"), share(F.col("slope") > 0).alias("rising"), share(up & raw).alias("significant_up"), share(~up & raw).alias("significant_down"), share(up & F.col("rejected")).alias("fdr_up"), r6(F.median("slope")).alias("median_slope"), r6(F.percentile("slope", 0.9)).alias("p90_slope"), F.max_by("cell", F.struct("slope", -F.col("cell"))).alias("steepest"))


def log_line(spark, sf_dir):
    a = _annual(spark, sf_dir).select("year", F.col("a").alias("v"))
    rate = X.log_trend(a, [], "year", "v").select((F.col("percent_per_year") / 100).alias("rate"))
    return rounded(X.log_line(a.crossJoin(F.broadcast(rate)), "year", "v", F.col("rate")).select("year", "line"), "line")  # one row


def slope_band(spark, sf_dir):
    """Fitted line and the lines of the slope's bounds, pivoted on the mean year."""
    a = _annual(spark, sf_dir).select("year", F.col("a").alias("v"))
    t = X.sen_tests(X.series(a, [], "year", "v")).select("slope", "slope_lo", "slope_hi", "intercept")
    mid = a.agg(F.avg("year").alias("mid"))
    j = a.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(mid))  # one row each
    at = F.col("intercept") + F.col("slope") * F.col("mid")
    lines = [r6(at + F.col(c) * (F.col("year") - F.col("mid"))).alias(n) for c, n in (("slope", "fit"), ("slope_lo", "low"), ("slope_hi", "high"))]
    return j.select("year", *lines)


def _places(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lon = F.lit(-125.0) + (F.col("c_custkey") * 7919 % 5900) / 100.0 + 0.003
    lat = F.lit(24.0) + (F.col("c_custkey") * 104729 % 2600) / 100.0 + 0.003
    return c.select(F.col("c_custkey").alias("id"), lon.alias("lon"), lat.alias("lat"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 5 != 0).alias("land"))


PLACES = """places AS (SELECT c_custkey AS id, CAST(-125.0 AS DOUBLE) + CAST(c_custkey * 7919 % 5900 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE) AS lon,
  CAST(24.0 AS DOUBLE) + CAST(c_custkey * 104729 % 2600 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE) AS lat, c_acctbal AS v, c_custkey % 5 <> 0 AS land FROM customer)"""
_N, _C, _RHO0 = G.Albers()._constants()
_E2 = G.Albers().e2
ALBERS = f"""q AS (SELECT *, {1 - _E2!r} * (sin(radians(lat)) / (1 - {_E2!r} * sin(radians(lat)) * sin(radians(lat)))
  - ln((1 - sqrt({_E2!r}) * sin(radians(lat))) / (1 + sqrt({_E2!r}) * sin(radians(lat)))) / (2 * sqrt({_E2!r}))) AS q FROM places),
xy AS (SELECT *, sqrt({_C!r} - {_N!r} * q) * {G.Albers().a / _N!r} * sin(radians(lon + 96) * {_N!r}) AS x, {_RHO0!r} - sqrt({_C!r} - {_N!r} * q) * {G.Albers().a / _N!r} * cos(radians(lon + 96) * {_N!r}) AS y FROM q),
cells AS (SELECT *, CASE WHEN x >= -3000000 AND x < 3050000 AND y <= 3350000 AND y > 100000 THEN CAST(floor((3350000 - y) / 25000) * 242 + floor((x + 3000000) / 25000) AS INT) END AS cell FROM xy)"""


def albers_forward(spark, sf_dir):
    p = _places(spark, sf_dir)
    x, y = G.Albers().forward(F.col("lon"), F.col("lat"))
    return p.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def albers_inverse(spark, sf_dir):
    """Forward and back again: the places themselves."""
    x, y = G.Albers().forward(F.col("lon"), F.col("lat"))
    p = _places(spark, sf_dir).withColumn("x", x).withColumn("y", y)
    lon, lat = G.Albers().inverse(F.col("x"), F.col("y"))
    return p.select("id", r6(lon).alias("lon"), r6(lat).alias("lat"))


def cell_index(spark, sf_dir):
    p = _places(spark, sf_dir)
    return p.select("id", G.TARGET.cell(*G.Albers().forward(F.col("lon"), F.col("lat"))).alias("cell")).where("cell is not null")


def target_grid(spark, sf_dir):
    """Places on the whole target grid: every cell with its centre and the number of places that it holds."""
    return S.scattered(cell_index(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")), G.TARGET.cells(spark))


def sinusoidal(spark, sf_dir):
    """Pixel centres of the tiles and pixels that the customers' numbers name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (8 + F.col("c_nationkey") % 6).alias("h"), (4 + F.col("c_nationkey") % 3).alias("v"), (F.col("c_custkey") * 7919 % 1200).alias("row"), (F.col("c_custkey") % 1200).alias("col"))
    lon, lat = G.sinusoidal_centres(F.col("h"), F.col("v"), F.col("row"), F.col("col"))
    return c.select("c_custkey", r6(lon).alias("lon"), r6(lat).alias("lat"))


def grid_remap_weighted(spark, sf_dir):
    x, y = G.Albers().forward(F.col("lon"), F.col("lat"))
    coarse = G.Grid(-3_000_000.0, 3_350_000.0, 250_000.0, 25, 13)
    got = S.remap(_places(spark, sf_dir), coarse, x, y, "v", F.col("lat"), [], F.col("land"))
    return got.where("land >= 0.5").select("cell", r6("value").alias("value"), r6("land").alias("land"))


def _boxes(spark, sf_dir):
    """Rectangles around some suppliers, as polygons."""
    s = table(spark, sf_dir, "supplier")
    x, y = F.lit(-124.0) + F.col("s_suppkey") * 1.37, F.lit(25.0) + (F.col("s_suppkey") * 7 % 20)
    w, h = 1.0 + F.col("s_suppkey") % 5, 0.5 + F.col("s_suppkey") % 3
    pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return s.select(F.col("s_suppkey").alias("shape"), F.array(F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h))).alias("rings"))


def _hits(spark, sf_dir):
    points = _places(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return S.point_in_polygon(points, _boxes(spark, sf_dir), 2.0)


def point_in_polygon(spark, sf_dir):
    return _hits(spark, sf_dir).select("id", "shape")


def covered_area(spark, sf_dir):
    """Dissolved area by class of shapes: a cell under several of them counts once."""
    h = _hits(spark, sf_dir).withColumn("class", (F.col("shape") % 3).cast("int"))
    return rounded(S.covered_area(h, ["class"], "id", F.cos(F.radians("y"))), "area")


def polygon_sizes(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("class", (F.col("shape") % 3).cast("int"))
    return b.groupBy("class").agg(F.count("*").alias("n"), r6(F.max(S.shoelace_area("rings[0]"))).alias("largest"))


def masked_smooth(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell"]).withColumn("row", F.floor(F.col("cell") / 5).cast("int")).withColumn("col", (F.col("cell") % 5).cast("int"))
    got = S.smoothed(c.withColumn("v", F.when(F.col("cell") % 6 != 0, F.col("a"))), "v", 1.0, 2)
    return rounded(got, "smooth", "weight")


def hexbins(spark, sf_dir):
    m = T.series_ratios(cube(spark, sf_dir), ["year", "month"])
    return rounded(S.hexbins(m, "b", "d", 2000.0), "log_n")


def seeded_sample(spark, sf_dir):
    return T.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 0)


QUERIES = {f.__name__: f for f in (
    sen_slope, sen_slope_join, kendall_tau, sen_with_tests, spearman_time, log_trend, growth_decomposition, ols, ols_p, correlations, correlations_p, bh_fdr, field_cells, field_test,
    spatial_summary, log_line, slope_band, albers_forward, albers_inverse, cell_index, target_grid, sinusoidal, grid_remap_weighted, point_in_polygon, covered_area, polygon_sizes,
    masked_smooth, hexbins, seeded_sample,
)}

Y = f"WITH {YEARLY}"
PAIRS = "p AS (SELECT a.{0} AS k, a.year AS x0, b.year AS x1, a.v AS y0, b.v AS y1 FROM {1} a JOIN {1} b ON a.{0} = b.{0} AND a.year < b.year)"
ANN = f"""WITH {CUBE}, ann AS (SELECT year, sum(a) AS a, sum(d) / sum(b) AS fraction, sum(c) / sum(b) AS flag_index, sum(a) / sum(b) AS mean_value, sum(c) / sum(d) AS intensity,
  (sum(a) - sum(c)) / (sum(b) - sum(d)) AS background FROM cube WHERE {SPAN} GROUP BY year)"""
BOXES = """boxes AS (SELECT s_suppkey AS shape, CAST(-124.0 AS DOUBLE) + s_suppkey * CAST(1.37 AS DOUBLE) AS x, CAST(25 + s_suppkey * 7 % 20 AS DOUBLE) AS y, 1 + s_suppkey % 5 AS w, CAST(0.5 AS DOUBLE) + s_suppkey % 3 AS h
  FROM supplier), hits AS (SELECT id, shape, lat FROM places JOIN boxes ON lon BETWEEN x AND x + w AND lat BETWEEN y AND y + h)"""

#: Numbers of permutations of n points with k inversions, from the rule in tests_of_significance, for the exact p of tau.
_EXACT = "inv(n, k, c) AS (VALUES " + ", ".join(f"({n}, {k}, {c})" for n in range(2, 9) for k, c in enumerate(inversions(n))) + ")"
#: Bounds of the slope and the exact p of tau, of series k without ties: after p, from the table of pairs.
TESTS = _EXACT + """, s AS (SELECT k, list_sort(list((y1 - y0) / (x1 - x0))) AS s, median((y1 - y0) / (x1 - x0)) AS slope, sum(sign(y1 - y0)) AS g,
  CAST(count(*) AS INT) AS m, CAST((1 + sqrt(1 + 8 * count(*))) / 2 AS INT) AS n FROM p GROUP BY k),
b AS (SELECT *, CAST(1.959963984540054 AS DOUBLE) * sqrt(n * (n - 1) * (2 * n + 5) / CAST(18 AS DOUBLE)) AS w FROM s),
t AS (SELECT k, slope, n, g / m AS tau, s[greatest(CAST(round((m - w) / 2) AS INT), 0) + 1] AS lo, s[least(CAST(round((m + w) / 2) AS INT), m)] AS hi,
  (SELECT least(1, 2 * CAST(sum(c) FILTER (inv.k <= (m - abs(g)) / 2) AS DOUBLE) / CAST(sum(c) AS DOUBLE)) FROM inv WHERE inv.n = b.n) AS tau_p FROM b)"""
#: Student's two-sided p of a whole number f of degrees of freedom at t: the finite sums for even and for odd ones.
_SUM = "list_sum(list_transform(range(0, CAST({n} AS BIGINT)), lambda k: exp({c}) * pow({f} / ({f} + {t} * {t}), k)))"
_EVEN = "1 - {t} / sqrt({f} + {t} * {t}) * " + _SUM.replace("{n}", "{f} / 2").replace("{c}", "lgamma(k + 0.5) - lgamma(k + 1)") + " / sqrt(pi())"
_ODD = "1 - 2 / pi() * (atan({t} / sqrt({f})) + {t} * sqrt({f}) / ({f} + {t} * {t}) * coalesce(" + _SUM.replace("{n}", "({f} - 1) / 2").replace("{c}", "lgamma(k + 1) - lgamma(k + 1.5)") + " * sqrt(pi()) / 2, 0))"
T_P = f"greatest(CAST(0 AS DOUBLE), CASE WHEN {{f}} % 2 = 0 THEN {_EVEN} ELSE {_ODD} END)"
PERMUTED = f"""WITH {YEARLY}, pt AS (SELECT cell, year, v, row_number() OVER (PARTITION BY cell ORDER BY year) - 1 AS i, 2 * rank() OVER (PARTITION BY cell ORDER BY v) + count(*) OVER (PARTITION BY cell, v) - 1 - count(*) OVER (PARTITION BY cell) - 1 AS r FROM yearly),
ax AS (SELECT DISTINCT i, year FROM pt), od AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || k || ':' || i)) - 1 AS j FROM range(1, 2001) t(k), ax UNION ALL SELECT 0, i, i FROM ax),
dl AS (SELECT k, j AS i, count(*) OVER (PARTITION BY k) * year - sum(year) OVER (PARTITION BY k) AS x FROM od JOIN ax USING (i)),
sc AS (SELECT cell, k, sum(r * x) AS s, sum(r * r) AS rr, sum(x * x) AS xx FROM pt JOIN dl USING (i) GROUP BY ALL), lv AS (SELECT *, rr > 0 AS live FROM sc)"""

ORACLES = {
    "sen_with_tests": f"{Y}, {PAIRS.format('cell', 'yearly')}, {TESTS} SELECT k AS cell, round(slope, 6) AS slope, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi, round(tau, 6) AS tau, round(tau_p, 6) AS tau_p FROM t",
    "spatial_summary": f"""{Y}, {PAIRS.format('cell', 'yearly')}, {TESTS}, o AS (SELECT *, row_number() OVER (ORDER BY tau_p) AS i, count(*) OVER () AS c FROM t), q AS (SELECT max(tau_p) AS cut FROM o WHERE tau_p <= CAST(0.05 AS DOUBLE) * i / c)
SELECT count(*) AS cells, round(avg(CAST(slope > 0 AS DOUBLE)), 6) AS rising, round(avg(CAST(tau > 0 AND tau_p < 0.05 AS DOUBLE)), 6) AS significant_up, round(avg(CAST(NOT tau > 0 AND tau_p < 0.05 AS DOUBLE)), 6) AS significant_down,
  round(avg(CAST(tau > 0 AND coalesce(tau_p <= cut, false) AS DOUBLE)), 6) AS fdr_up, round(median(slope), 6) AS median_slope, round(quantile_cont(slope, 0.9), 6) AS p90_slope, arg_max(k, slope) AS steepest FROM t, q""",
    "slope_band": f"""{ANN}, z AS (SELECT 1 AS s, year, a AS v FROM ann), {PAIRS.format('s', 'z')}, {TESTS}, m AS (SELECT median(v) - any_value(slope) * median(year) + any_value(slope) * avg(year) AS base, avg(year) AS mid FROM z, t)
SELECT year, round(base + slope * (year - mid), 6) AS fit, round(base + lo * (year - mid), 6) AS low, round(base + hi * (year - mid), 6) AS high FROM z, t, m""",
    "ols_p": f"""{Y}, o AS (SELECT cell, regr_r2(v, year) AS r2, CAST(count(*) - 2 AS DOUBLE) AS f FROM yearly GROUP BY cell), h AS (SELECT *, sqrt(r2 * f / (1 - r2)) AS t FROM o) SELECT cell, round({T_P.format(t='t', f='f')}, 6) AS p FROM h""",
    "correlations_p": f"""WITH {CUBE}, m AS (SELECT sum(b) AS a, CASE WHEN month % 4 <> 0 THEN sum(d) END AS b FROM cube GROUP BY year, month), ok AS (SELECT * FROM m WHERE b IS NOT NULL),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM ok),
c AS (SELECT count(*) AS n, CAST(count(*) - 2 AS DOUBLE) AS f, abs(corr(a, b)) AS p, abs(corr(ra, rb)) AS s FROM r), h AS (SELECT n, f, p * sqrt(f / (1 - p * p)) AS tp, s * sqrt(f / (1 - s * s)) AS ts FROM c)
SELECT n, round({T_P.format(t='tp', f='f')}, 6) AS pearson_p, round({T_P.format(t='ts', f='f')}, 6) AS spearman_p FROM h""",
    "field_cells": f"""{PERMUTED} SELECT cell, round(max(s) FILTER (k = 0) / sqrt(any_value(CAST(rr AS DOUBLE)) * any_value(CAST(xx AS DOUBLE))), 6) AS rho, round((1 + count(*) FILTER (k > 0 AND abs(s) >= abs(o))) / CAST(2001 AS DOUBLE), 6) AS p_cell, any_value(live) AS live
FROM lv JOIN (SELECT cell, s AS o FROM lv WHERE k = 0) USING (cell) GROUP BY cell""",
    "field_test": f"""{PERMUTED}, bar AS (SELECT cell, quantile_cont(CAST(abs(s) AS DOUBLE), 0.95) AS bar FROM lv WHERE live AND k > 0 GROUP BY cell),
f AS (SELECT k, count(*) AS n, count(*) FILTER (abs(s) >= bar) AS h, count(*) FILTER (s > 0) AS u FROM lv JOIN bar USING (cell) GROUP BY k), o AS (SELECT n AS n_cells, h AS oh, u AS ou FROM f WHERE k = 0)
SELECT n_cells, round(oh / CAST(n_cells AS DOUBLE), 6) AS significant, round(ou / CAST(n_cells AS DOUBLE), 6) AS up, round(quantile_cont(h / CAST(n AS DOUBLE), 0.95), 6) AS null_significant_p95, round((1 + count(*) FILTER (h >= oh)) / CAST(2001 AS DOUBLE), 6) AS significant_p,
  round(quantile_cont(u / CAST(n AS DOUBLE), 0.95), 6) AS null_up_p95, round((1 + count(*) FILTER (u >= ou)) / CAST(2001 AS DOUBLE), 6) AS up_p FROM f, o WHERE k > 0 GROUP BY ALL""",
    "sinusoidal": """WITH s AS (SELECT c_custkey, 8 + c_nationkey % 6 AS h, 4 + c_nationkey % 3 AS v, c_custkey * 7919 % 1200 AS row, c_custkey % 1200 AS col FROM customer),
y AS (SELECT c_custkey, (pi() / 2 - (v + (row + CAST(0.5 AS DOUBLE)) / 1200) * pi() / 18) AS lat, (-pi() + (h + (col + CAST(0.5 AS DOUBLE)) / 1200) * pi() / 18) AS x FROM s)
SELECT c_custkey, round(degrees(x / cos(lat)), 6) AS lon, round(degrees(lat), 6) AS lat FROM y""",
    "seeded_sample": "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':0'), c_custkey LIMIT 100",
    "sen_slope": f"""{Y}, {PAIRS.format('cell', 'yearly')}, s AS (SELECT k AS cell, median((y1 - y0) / (x1 - x0)) AS slope FROM p GROUP BY k), m AS (SELECT cell, median(year) AS mx, median(v) AS my, count(*) AS n FROM yearly GROUP BY cell)
SELECT cell, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, n FROM s JOIN m USING (cell)""",
    "sen_slope_join": f"{Y}, {PAIRS.format('cell', 'yearly')} SELECT k AS cell, round(median((y1 - y0) / (x1 - x0)), 6) AS slope FROM p GROUP BY k",
    "kendall_tau": f"{Y}, {PAIRS.format('cell', 'yearly')} SELECT k AS cell, round(sum(sign(y1 - y0)) / nullif(sqrt(CAST(count(*) AS DOUBLE) * sum(abs(sign(y1 - y0)))), 0), 6) AS tau FROM p GROUP BY k",
    "spearman_time": f"{Y}, r AS (SELECT cell, year, rank() OVER (PARTITION BY cell ORDER BY v) + (count(*) OVER (PARTITION BY cell, v) - 1) / 2.0 AS r FROM yearly) SELECT cell, round(corr(year, r), 6) AS rho FROM r GROUP BY cell",
    "log_trend": f"""{Y}, l AS (SELECT cell, year, ln(v) AS v FROM yearly WHERE v > 0), {PAIRS.format('cell', 'l')}, {TESTS}, n AS (SELECT cell, count(*) AS n FROM l GROUP BY cell), sp AS (SELECT cell, max(year) - min(year) AS s FROM yearly GROUP BY cell)
SELECT cell, round(100 * slope, 6) AS percent_per_year, round(100 * lo, 6) AS percent_lo, round(100 * hi, 6) AS percent_hi, round(exp(slope * s), 6) AS factor, round(tau, 6) AS tau, round(tau_p, 6) AS tau_p, n.n FROM t JOIN n ON n.cell = t.k JOIN sp USING (cell)""",
    "growth_decomposition": f"""{ANN}, l AS (UNPIVOT (SELECT year, fraction, intensity, flag_index, mean_value, background FROM ann) ON fraction, intensity, flag_index, mean_value, background INTO NAME s VALUE y),
z AS (SELECT s, year, ln(y) AS v FROM l), {PAIRS.format('s', 'z')}, r AS (SELECT k, 100 * median((y1 - y0) / (x1 - x0)) AS r FROM p GROUP BY k),
w AS (SELECT max(r) FILTER (k = 'fraction') AS f, max(r) FILTER (k = 'intensity') AS i, max(r) FILTER (k = 'flag_index') AS x, max(r) FILTER (k = 'mean_value') AS m, max(r) FILTER (k = 'background') AS b FROM r)
SELECT round(f, 6) AS fraction, round(i, 6) AS intensity, round(x, 6) AS flag_index, round(m, 6) AS mean_value, round(b, 6) AS background, round(f + i, 6) AS total, round(x - (f + i), 6) AS residual, round(f / (f + i), 6) AS fraction_share FROM w""",
    "ols": f"{Y} SELECT cell, round(regr_slope(v, year), 6) AS slope, round(regr_intercept(v, year), 6) AS intercept, round(regr_r2(v, year), 6) AS r2, CAST(regr_count(v, year) AS BIGINT) AS n FROM yearly GROUP BY cell",
    "correlations": f"""WITH {CUBE}, m AS (SELECT sum(b) AS a, CASE WHEN month % 4 <> 0 THEN sum(d) END AS b FROM cube GROUP BY year, month), ok AS (SELECT * FROM m WHERE b IS NOT NULL),
o AS (SELECT coalesce(min(a) FILTER (a > 0) / 2, 1) AS oa, coalesce(min(b) FILTER (b > 0) / 2, 1) AS ob FROM ok), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM ok)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson_r, round(corr(ra, rb), 6) AS spearman_r, round(corr(log10(a + oa), log10(b + ob)), 6) AS log_pearson_r FROM r, o""",
    "bh_fdr": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN pow(CAST(c_custkey % 997 AS DOUBLE) / 997, 3) END AS p FROM customer),
k AS (SELECT p, row_number() OVER (ORDER BY p) AS k, (SELECT count(*) FROM t) AS n FROM t WHERE p IS NOT NULL), c AS (SELECT max(p) AS cut FROM k WHERE p <= 0.05 * k / n)
SELECT c_custkey, coalesce(p <= cut, false) AS rejected FROM t, c""",
    "log_line": f"{ANN}, r AS (SELECT median((ln(q.a) - ln(p.a)) / (q.year - p.year)) AS rate FROM ann p JOIN ann q ON p.year < q.year) SELECT year, round(exp(avg(ln(a)) OVER () + rate * (year - avg(year) OVER ())), 6) AS line FROM ann, r",
    "albers_forward": f"WITH {PLACES}, {ALBERS} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM cells",
    "albers_inverse": f"WITH {PLACES} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places",
    "cell_index": f"WITH {PLACES}, {ALBERS} SELECT id, cell FROM cells WHERE cell IS NOT NULL",
    "target_grid": f"""WITH {PLACES}, {ALBERS}, k AS (SELECT cell, count(*) AS n FROM cells WHERE cell IS NOT NULL GROUP BY cell), g AS (SELECT CAST(i AS INT) AS cell, CAST(i // 242 AS INT) AS row, CAST(i % 242 AS INT) AS col,
  CAST(-3000000 + (i % 242 + 0.5) * 25000 AS DOUBLE) AS x, CAST(3350000 - (i // 242 + 0.5) * 25000 AS DOUBLE) AS y FROM range(31460) t(i)) SELECT g.*, n FROM g LEFT JOIN k USING (cell)""",
    "grid_remap_weighted": f"""WITH {PLACES}, {ALBERS}, k AS (SELECT *, CAST(floor((3350000 - y) / 250000) * 25 + floor((x + 3000000) / 250000) AS INT) AS big, cos(radians(lat)) AS w FROM cells
  WHERE floor((x + 3000000) / 250000) BETWEEN 0 AND 24 AND floor((3350000 - y) / 250000) BETWEEN 0 AND 12), s AS (SELECT big AS cell, sum(v * w) FILTER (land) / nullif(sum(w) FILTER (land), 0) AS value, coalesce(sum(w) FILTER (land), 0) / sum(w) AS land FROM k GROUP BY big)
SELECT cell, round(value, 6) AS value, round(land, 6) AS land FROM s WHERE land >= 0.5""",
    "point_in_polygon": f"WITH {PLACES}, {BOXES} SELECT id, shape FROM hits",
    "covered_area": f"WITH {PLACES}, {BOXES}, d AS (SELECT DISTINCT CAST(shape % 3 AS INT) AS class, id, cos(radians(lat)) AS a FROM hits) SELECT class, round(sum(a), 6) AS area, count(*) AS cells FROM d GROUP BY class",
    "polygon_sizes": f"WITH {PLACES}, {BOXES} SELECT CAST(shape % 3 AS INT) AS class, count(*) AS n, round(max(w * h), 6) AS largest FROM boxes GROUP BY ALL",
    "masked_smooth": f"""WITH {CUBE}, s AS (SELECT cell // 5 AS row, cell % 5 AS col, cell, sum(a) AS a FROM cube GROUP BY ALL), g AS (SELECT i, exp(-i * i / CAST(2 AS DOUBLE)) / (SELECT sum(exp(-j * j / CAST(2 AS DOUBLE))) FROM range(-2, 3) t(j)) AS w FROM range(-2, 3) t(i)),
k AS (SELECT o.row, o.col, sum(s.a * gr.w * gc.w) AS v, sum(gr.w * gc.w) AS w FROM s o JOIN s ON abs(s.row - o.row) <= 2 AND abs(s.col - o.col) <= 2 AND s.cell % 6 <> 0 JOIN g gr ON gr.i = o.row - s.row JOIN g gc ON gc.i = o.col - s.col GROUP BY ALL)
SELECT row, col, round(v / w, 6) AS smooth, round(w, 6) AS weight FROM k WHERE w > 0.35""",
    "hexbins": f"WITH {CUBE}, m AS (SELECT sum(b) AS b, sum(d) AS d FROM cube GROUP BY year, month) SELECT CAST(floor(b / 2000) AS BIGINT) AS bx, CAST(floor(d / 2000) AS BIGINT) AS by, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM m GROUP BY ALL",
}
