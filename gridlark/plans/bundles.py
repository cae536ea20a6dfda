"""Plans that put several operators together: trend bundles, alignment of products, domains, and tables written and read back."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridlark.functions import columns as C
from gridlark.functions import grid as G
from gridlark.operators import spatial as S
from gridlark.operators import tables as T
from gridlark.operators import trends as X
from gridlark.plans.archive import FIRST, LAST, SPAN
from gridlark.plans.inputs import CUBE, DAILY, YEARLY, cube, daily, rounded, table, yearly_cells
from gridlark.plans.statistics import ANN, PAIRS, T_P, TESTS, _annual, _boxes
from gridlark.session import scratch
from gridlark.sources import granules, store


def record_and_trend(spark, sf_dir):
    """One row on the domain's annual series: extremes, trends of several kinds, the two halves, and the share of the last years."""
    a = _annual(spark, sf_dir).select("year", (F.col("a") / 1000).alias("v"))
    facts = a.agg(
        F.count("*").alias("n_years"), F.avg("v").alias("mean_value"), F.median("v").alias("median_value"), F.min_by("year", "v").alias("min_year"), F.min("v").alias("min_value"),
        F.max_by("year", "v").alias("max_year"), F.max("v").alias("max_value"), (F.max("v") / F.min("v")).alias("max_over_min"), (F.sum(F.when(F.col("year") > LAST - 2, F.col("v"))) / F.sum("v")).alias("last_share"),
    )
    trend = X.sen_tests(X.series(a, [], "year", "v")).select("slope", "slope_lo", "slope_hi", "tau", "tau_p")
    without = X.sen(X.series(a.where(~F.col("year").isin(1997, 1998)), [], "year", "v")).select(F.col("slope").alias("slope_without"))
    line = X.ols(a, [], "year", "v").select(F.col("slope").alias("ols_slope"), F.col("r2").alias("ols_r2"), F.col("p").alias("ols_p"))
    growth = X.log_trend(a, [], "year", "v").select("percent_per_year")
    half = F.when(F.col("year") < (FIRST + LAST + 1) // 2, F.col("v")), F.when(F.col("year") >= (FIRST + LAST + 1) // 2, F.col("v"))
    welch = a.agg(*[f(h).alias(f"{n}{k}") for k, h in enumerate(half) for n, f in (("m", F.avg), ("s", F.var_samp), ("c", F.count))])
    e0, e1 = F.col("s0") / F.col("c0"), F.col("s1") / F.col("c1")
    welch = welch.select(
        F.col("m0").alias("early_mean"), F.col("m1").alias("late_mean"), (F.col("m1") / F.col("m0")).alias("ratio"), ((F.col("m0") - F.col("m1")) / F.sqrt(e0 + e1)).alias("welch_t"),
        ((e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("c0") - 1) + e1 * e1 / (F.col("c1") - 1))).alias("welch_df"),
    )
    out = facts
    for one in (trend, without, line, growth, X.with_t_p(welch, "welch_t", "welch_df", "welch_p")):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return rounded(out, *[c for c in out.columns if c not in ("n_years", "min_year", "max_year")])


def _with_region(cells):
    """Cells from west to east, 2.4 degrees apart."""
    return cells.withColumn("region", C.region(F.lit(-125.0) + F.col("cell") * 2.4))


def region_trends(spark, sf_dir):
    """By region: cells, mean of both halves and their ratio, trend of the mean series, share of rising cells, year of the peak."""
    cells = _with_region(yearly_cells(spark, sf_dir))
    mean = cells.groupBy("region", "year").agg(F.avg("v").alias("v"))
    late = F.col("year") >= (FIRST + LAST + 1) // 2
    facts = mean.groupBy("region").agg(F.avg("v").alias("mean_value"), F.avg(F.when(~late, F.col("v"))).alias("early_mean"), F.avg(F.when(late, F.col("v"))).alias("late_mean"), F.max_by("year", "v").alias("peak_year"))
    slopes = X.sen(X.series(cells, ["region", "cell"], "year", "v")).groupBy("region").agg(F.count("*").alias("n_cells"), F.avg((F.col("slope") > 0).cast("double")).alias("rising"))
    trend = X.sen(X.series(mean, ["region"], "year", "v")).select("region", "slope", "tau")
    out = facts.withColumn("ratio", F.col("late_mean") / F.col("early_mean")).join(slopes, "region").join(trend, "region")
    return rounded(out, "mean_value", "early_mean", "late_mean", "ratio", "rising", "slope", "tau")


def _covered(spark, sf_dir):
    """(cell, q): a cell's coverage over the window against the median cell's."""
    cover = cube(spark, sf_dir).where(F.col("year").between(FIRST, LAST)).groupBy("cell").agg(F.sum("b").alias("cover"))
    return cover.crossJoin(F.broadcast(cover.agg(F.median("cover").alias("mid")))).select("cell", (F.col("cover") / F.col("mid")).alias("q"))  # one row


def robustness(spark, sf_dir):
    """The trend under seven choices of weights, screens and windows; dropped: cells that the screen leaves out."""
    year = F.col("year")
    every = T.series_ratios(cube(spark, sf_dir), ["year"]).select("year", F.col("mean_value").alias("v"))
    window, cells, q = every.where(year.between(FIRST, LAST)), yearly_cells(spark, sf_dir), _covered(spark, sf_dir)
    equal = lambda least: cells.join(q.where(F.col("q") >= least), "cell").groupBy("year").agg(F.avg("v").alias("v"))
    choices = {
        "weighted": window, "equal_cells": equal(0.0), "covered_80": equal(0.8), "covered_100": equal(1.0),
        "without_two": window.where(~year.isin(1997, 1998)), "short": window.where("year >= 1997"), "extended": every.where(year.between(FIRST, LAST + 1)),
    }
    out = None
    for name, df in choices.items():
        part = df.select(F.lit(name).alias("choice"), "year", "v")
        out = part if out is None else out.unionByName(part)
    t = X.sen_tests(X.series(out, ["choice"], "year", "v")).join(out.groupBy("choice").agg(F.avg("v").alias("mean")), "choice")
    least = F.when(F.col("choice") == "covered_80", 0.8).when(F.col("choice") == "covered_100", 1.0).otherwise(0.0)
    dropped = t.select("choice", least.alias("least")).crossJoin(F.broadcast(q)).groupBy("choice").agg(F.count_if(F.col("q") < F.col("least")).alias("dropped"))  # seven rows by the grid's cells
    t = t.join(dropped, "choice").select("choice", "mean", "slope", "slope_lo", "slope_hi", "tau", "tau_p", "n", "dropped")
    return rounded(t, "mean", "slope", "slope_lo", "slope_hi", "tau", "tau_p")


def coverage_correlation(spark, sf_dir):
    """Rank correlation of a cell's coverage with its mean."""
    mean = yearly_cells(spark, sf_dir).groupBy("cell").agg(F.avg("v").alias("mean"))
    return rounded(X.correlations(_covered(spark, sf_dir).join(mean, "cell"), "q", "mean").select("n", "spearman_r"), "spearman_r")


def aligned_products(spark, sf_dir):
    """Two products side by side where both have the year and the cell."""
    o = table(spark, sf_dir, "orders")
    other = o.groupBy((F.col("o_custkey") % 30).cast("int").alias("cell"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1000).alias("other"))
    return rounded(yearly_cells(spark, sf_dir).join(other, ["year", "cell"]), "v", "other")


def nested_field(spark, sf_dir):
    """The name in a nested record, or the end of the link where the record has none."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"].cast("string")
    umm = F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("unit-"), k)).when(F.col("event_id") % 3 == 1, F.lit("")).alias("name"))
    e = e.select("event_id", umm.alias("umm"), F.concat(F.lit("https://host/data/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("link"))
    return e.select("event_id", C.nested_name("umm.name", "link").alias("name"))


def month_list(spark, sf_dir):
    """The months of the shipments of the largest quantity, each once, with their last days."""
    labels = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.date_format("l_shipdate", "yyyy-MM").alias("m")).distinct().orderBy("m").collect()  # months
    listed = C.month_list(spark, [r["m"] for r in labels])
    return listed.withColumns({c: F.col(c).cast("string") for c in ("month", "last_day")})


def seasons_by_map(spark, sf_dir):
    """Counts by a map's label of the month; months that it doesn't list have none."""
    names = F.create_map(*[F.lit(x) for m, s in ((12, "winter"), (1, "winter"), (2, "winter"), (6, "summer"), (7, "summer"), (8, "summer")) for x in (m, s)])
    o = table(spark, sf_dir, "orders").select(F.coalesce(F.try_element_at(names, F.month("o_orderdate")), F.lit("other")).alias("season"))
    return o.groupBy("season").agg(F.count("*").alias("n"))


def optional_link(spark, sf_dir):
    """A statistic of another run beside each region, null where that run has left no file."""
    path = scratch(spark)
    table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("found")).where("region <> 2").write.json(path)
    schema = "region int, found long"
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    here, gone = store.optional_json(spark, path, schema), store.optional_json(spark, f"{path}-absent", schema)
    return regions.join(here, "region", "left").join(gone.withColumnRenamed("found", "absent"), "region", "left")


def finished_runs(spark, sf_dir):
    """Which of two outputs carries its terminal marker; the second one's was taken away, as after a crash."""
    path = scratch(spark)
    for name in ("whole", "broken"):
        table(spark, sf_dir, "region").write.parquet(f"{path}/{name}")
    store.unmark(spark, f"{path}/broken")
    found = [(name, store.is_finished(spark, f"{path}/{name}")) for name in ("whole", "broken", "absent")]
    return spark.createDataFrame(found, "name string, finished boolean")


def csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    days = daily(spark, sf_dir).select("day", F.round("value", 3).alias("value"), F.when(F.dayofmonth("day") > 1, F.round("total", 3)).alias("total"))
    store.write_csv(days, path, ["day"])
    return store.read_csv(spark, path, "day date, value double, total double").withColumn("day", F.col("day").cast("string"))


def cube_round_trip(spark, sf_dir):
    """The cube written by year with its properties, read back with the years pruned and the values as they are stored."""
    path = scratch(spark)
    store.write_cube(cube(spark, sf_dir).select("year", "month", "cell", "b", "d"), path, values=["b", "d"])
    store.write_properties(spark, path, {"title": "counts", "grid": "25 cells"})
    back = store.read_cubes(spark, [path]).where(F.col("year").between(1996, 1997))
    title = store.read_properties(spark, path).where("name = 'title'").select(F.col("value").alias("title"))
    return back.groupBy("year", "cell").agg(F.sum("b").alias("b"), F.sum("d").alias("d")).crossJoin(F.broadcast(title))  # one row


def json_summary(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    return store.summary_json(n, "n_nationkey")


#: Side of the granules that the plans write.
_SIDE = 6


def _files(spark, sf_dir):
    """One granule by nation, written to disk and scanned as files: as many planes as the region's number tells, none for a single flat one.

    Text is the only sink of Spark whose files are a row's own bytes, so the containers stand in base64.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, planes in zip(part["n_nationkey"], part["n_regionkey"]):
            shape = (planes, _SIDE, _SIDE) if planes else (_SIDE, _SIDE)
            i = np.arange(max(planes, 1) * _SIDE * _SIDE)
            content = granules.packed({"grid1km:Optical_Depth_055": (n * 100 + i).astype("i2").reshape(shape), "grid1km:AOD_QA": (i % 5).astype("u2").reshape(shape), "grid5km:AOD_QA": i[:1].astype("u2")}, (1, 4, 4))
            out.append((n, base64.b64encode(content).decode()))
        return pd.DataFrame(out, columns=["granule", "value"])

    path, n = scratch(spark), table(spark, sf_dir, "nation")
    n.select("n_nationkey", "n_regionkey").groupBy("n_nationkey").applyInPandas(pack, "granule int, value string").write.partitionBy("granule").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    number = F.regexp_extract("path", "granule=([0-9]+)", 1).cast("int").alias("n_nationkey")
    return files.select(number, F.unbase64(F.decode("content", "UTF-8")).alias("content")).join(F.broadcast(n), "n_nationkey").select(F.col("n_name").alias("path"), "content")  # 25 nations


def granule_pixels(spark, sf_dir):
    return granules.pixels(_files(spark, sf_dir), side=_SIDE).withColumnRenamed("path", "name")


def granule_shapes(spark, sf_dir):
    """What each granule holds, without taking its pixels out."""
    found = granules.described(_files(spark, sf_dir))
    return found.select(F.col("path").alias("name"), F.array_join("variables", ",").alias("variables"), F.array_join("shape", "x").alias("shape"), "problem")


def domain_cells(spark, sf_dir):
    """Cells of the tenth-degree grid whose centre is in one of the domain's shapes: those of some nations are left out, and some must be left."""
    s = table(spark, sf_dir, "supplier").where(~F.col("s_nationkey").isin(0, 3, 7)).select(F.col("s_suppkey").alias("shape"))
    shapes = _boxes(spark, sf_dir).join(s, "shape").withColumn("rings", F.expr("transform(rings, r -> transform(r, p -> named_struct('x', p.x - 0.013D, 'y', p.y)))"))
    counted = shapes.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") > 0, "no shape is left").alias("ok"))
    cells = G.TENTH_DEGREE.cells(spark).select("cell", "x", "y")
    hits = S.point_in_polygon(cells, S.repaired(shapes), 2.0).crossJoin(F.broadcast(counted))  # one row
    return hits.where("ok is null").select("cell").distinct()


QUERIES = {f.__name__: f for f in (
    record_and_trend, region_trends, robustness, coverage_correlation, aligned_products, nested_field, month_list, seasons_by_map, optional_link, finished_runs,
    csv_round_trip, cube_round_trip, json_summary, granule_pixels, granule_shapes, domain_cells,
)}

_MID = (FIRST + LAST + 1) // 2
_PDF = "exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(pi() * f) * pow(1 + x * x / f, -(f + 1) / 2)"
#: Student's two-sided p of any number of degrees of freedom, by Simpson's rule over 2000 steps.
_SIMPSON = f"SELECT 1 - 2 * sum(g * ({_PDF})) * abs(any_value(t)) / 6000 FROM (SELECT t, f, abs(t) * i / 2000 AS x, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS g FROM w, range(2001) r(i))"
_Q = f"cover AS (SELECT cell, sum(b) AS cover FROM cube WHERE {SPAN} GROUP BY cell), q AS (SELECT cell, cover / (SELECT median(cover) FROM cover) AS q FROM cover)"
_LOG = "z AS (SELECT 0 AS s, year, ln(v) AS v FROM a), zp AS (SELECT 100 * median((b.v - a.v) / (b.year - a.year)) AS percent_per_year FROM z a JOIN z b ON a.year < b.year)"

ORACLES = {
    "record_and_trend": f"""{ANN}, a AS (SELECT 0 AS s, year, a / 1000 AS v FROM ann), {PAIRS.format('s', 'a')}, {TESTS}, {_LOG},
wo AS (SELECT median((b.v - a.v) / (b.year - a.year)) AS slope_without FROM a JOIN a b ON a.year < b.year WHERE a.year NOT IN (1997, 1998) AND b.year NOT IN (1997, 1998)),
o AS (SELECT regr_slope(v, year) AS ols_slope, regr_r2(v, year) AS ols_r2, CAST(count(*) - 2 AS DOUBLE) AS f FROM a), op AS (SELECT *, sqrt(ols_r2 * f / (1 - ols_r2)) AS tt FROM o),
h AS (SELECT avg(v) FILTER (year < {_MID}) AS m0, avg(v) FILTER (year >= {_MID}) AS m1, var_samp(v) FILTER (year < {_MID}) / count(*) FILTER (year < {_MID}) AS e0, var_samp(v) FILTER (year >= {_MID}) / count(*) FILTER (year >= {_MID}) AS e1,
  count(*) FILTER (year < {_MID}) AS c0, count(*) FILTER (year >= {_MID}) AS c1 FROM a), w AS (SELECT *, (m0 - m1) / sqrt(e0 + e1) AS t, (e0 + e1) * (e0 + e1) / (e0 * e0 / (c0 - 1) + e1 * e1 / (c1 - 1)) AS f FROM h),
x AS (SELECT count(*) AS n_years, avg(v) AS mean_value, median(v) AS median_value, arg_min(year, v) AS min_year, min(v) AS min_value, arg_max(year, v) AS max_year, max(v) AS max_value, max(v) / min(v) AS max_over_min, sum(v) FILTER (year > {LAST - 2}) / sum(v) AS last_share FROM a)
SELECT n_years, round(mean_value, 6) AS mean_value, round(median_value, 6) AS median_value, min_year, round(min_value, 6) AS min_value, max_year, round(max_value, 6) AS max_value, round(max_over_min, 6) AS max_over_min, round(last_share, 6) AS last_share,
  round(slope, 6) AS slope, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi, round(tau, 6) AS tau, round(tau_p, 6) AS tau_p, round(slope_without, 6) AS slope_without, round(ols_slope, 6) AS ols_slope, round(ols_r2, 6) AS ols_r2, round({T_P.format(t='tt', f='op.f')}, 6) AS ols_p,
  round(percent_per_year, 6) AS percent_per_year, round(m0, 6) AS early_mean, round(m1, 6) AS late_mean, round(m1 / m0, 6) AS ratio, round(w.t, 6) AS welch_t, round(w.f, 6) AS welch_df, round(({_SIMPSON}), 6) AS welch_p FROM x, t, wo, op, zp, w""",
    "region_trends": f"""WITH {YEARLY}, c AS (SELECT *, CASE WHEN -125 + cell * 2.4 < -105 THEN 'West' WHEN -125 + cell * 2.4 < -90 THEN 'Central' ELSE 'East' END AS region FROM yearly), m AS (SELECT region, year, avg(v) AS v FROM c GROUP BY ALL),
f AS (SELECT region, avg(v) AS mean_value, avg(v) FILTER (year < {_MID}) AS early_mean, avg(v) FILTER (year >= {_MID}) AS late_mean, arg_max(year, v) AS peak_year FROM m GROUP BY region),
cs AS (SELECT a.region, a.cell, median((b.v - a.v) / (b.year - a.year)) AS s FROM c a JOIN c b ON a.cell = b.cell AND a.year < b.year GROUP BY ALL), n AS (SELECT region, count(*) AS n_cells, avg(CAST(s > 0 AS DOUBLE)) AS rising FROM cs GROUP BY region), {PAIRS.format('region', 'm')},
t AS (SELECT k AS region, median((y1 - y0) / (x1 - x0)) AS slope, avg(sign(y1 - y0)) AS tau FROM p GROUP BY k)
SELECT region, round(mean_value, 6) AS mean_value, round(early_mean, 6) AS early_mean, round(late_mean, 6) AS late_mean, peak_year, round(late_mean / early_mean, 6) AS ratio, n_cells, round(rising, 6) AS rising, round(slope, 6) AS slope, round(tau, 6) AS tau FROM f JOIN n USING (region) JOIN t USING (region)""",
    "robustness": f"""WITH {CUBE}, e AS (SELECT year, sum(a) / sum(b) AS v FROM cube GROUP BY year), y AS (SELECT cell, year, sqrt(sum(a)) AS v FROM cube WHERE {SPAN} GROUP BY ALL), {_Q},
u AS (SELECT 'weighted' AS c, year, v FROM e WHERE {SPAN} UNION ALL SELECT 'equal_cells', year, avg(v) FROM y GROUP BY year UNION ALL SELECT 'covered_80', year, avg(v) FROM y JOIN q USING (cell) WHERE q >= CAST(0.8 AS DOUBLE) GROUP BY year UNION ALL SELECT 'covered_100', year, avg(v) FROM y JOIN q USING (cell) WHERE q >= 1 GROUP BY year
  UNION ALL SELECT 'without_two', year, v FROM e WHERE {SPAN} AND year NOT IN (1997, 1998) UNION ALL SELECT 'short', year, v FROM e WHERE {SPAN} AND year >= 1997 UNION ALL SELECT 'extended', year, v FROM e WHERE year BETWEEN {FIRST} AND {LAST + 1}),
{PAIRS.format('c', 'u')}, {TESTS}, g AS (SELECT c, avg(v) AS mean, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY c)
SELECT c AS choice, round(mean, 6) AS mean, round(slope, 6) AS slope, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi, round(tau, 6) AS tau, round(tau_p, 6) AS tau_p, g.n,
  (SELECT count(*) FROM q WHERE q < CASE c WHEN 'covered_80' THEN CAST(0.8 AS DOUBLE) WHEN 'covered_100' THEN 1 ELSE 0 END) AS dropped FROM t JOIN g ON g.c = t.k""",
    "coverage_correlation": f"""WITH {YEARLY}, {_Q}, j AS (SELECT q, m FROM q JOIN (SELECT cell, avg(v) AS m FROM yearly GROUP BY cell) USING (cell)),
r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rm FROM j) SELECT count(*) AS n, round(corr(rq, rm), 6) AS spearman_r FROM r""",
    "aligned_products": f"""WITH {YEARLY}, o AS (SELECT CAST(o_custkey % 30 AS INT) AS cell, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) / 1000 AS other FROM orders GROUP BY ALL) SELECT year, cell, round(v, 6) AS v, round(other, 6) AS other FROM yearly JOIN o USING (year, cell)""",
    "nested_field": """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'unit-' || json_extract_string(props, '$.k') END, CAST(event_id AS VARCHAR)) AS name FROM events""",
    "month_list": "SELECT DISTINCT strftime(l_shipdate, '%Y-%m-01') AS month, CAST(last_day(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_day, strftime(l_shipdate, '%Y-%m') AS label FROM lineitem WHERE l_quantity = 50",
    "seasons_by_map": "SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'other' END AS season, count(*) AS n FROM orders GROUP BY ALL",
    "optional_link": "SELECT r_regionkey AS region, r_name, CASE WHEN r_regionkey <> 2 THEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS found, CAST(NULL AS BIGINT) AS absent FROM region",
    "finished_runs": "SELECT * FROM (VALUES ('whole', true), ('broken', false), ('absent', false)) t(name, finished)",
    "csv_round_trip": f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, round(value, 3) AS value, CASE WHEN day(day) > 1 THEN round(total, 3) END AS total FROM daily",
    "cube_round_trip": f"WITH {CUBE} SELECT year, cell, sum(b) AS b, sum(d) AS d, 'counts' AS title FROM cube WHERE year BETWEEN 1996 AND 1997 GROUP BY ALL",
    "json_summary": "SELECT CAST(to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: nullif(n_regionkey, 0)}) AS VARCHAR) AS value FROM nation",
    "granule_pixels": f"""SELECT n_name AS name, CAST(i // {_SIDE**2} AS INT) AS obs, CAST(i % {_SIDE**2} // {_SIDE} AS INT) AS "row", CAST(i % {_SIDE} AS INT) AS col, CAST(n_nationkey * 100 + i AS INT) AS raw, CAST(i % 5 AS INT) AS quality
FROM nation, range({4 * _SIDE**2}) t(i) WHERE i < greatest(n_regionkey, 1) * {_SIDE**2}""",
    "granule_shapes": f"""SELECT n_name AS name, 'grid1km:AOD_QA,grid1km:Optical_Depth_055,grid5km:AOD_QA' AS variables, CASE WHEN n_regionkey > 0 THEN n_regionkey || 'x' ELSE '' END || '{_SIDE}x{_SIDE}' AS shape, CAST(NULL AS VARCHAR) AS problem FROM nation""",
    "domain_cells": """WITH g AS (SELECT CAST(i AS INT) AS cell, CAST(-125 AS DOUBLE) + (i % 590 + CAST(0.5 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS x, CAST(50 AS DOUBLE) - (i // 590 + CAST(0.5 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS y FROM range(153400) t(i)),
b AS (SELECT CAST(-124.013 AS DOUBLE) + s_suppkey * CAST(1.37 AS DOUBLE) AS x0, 25 + s_suppkey * 7 % 20 AS y0, 1 + s_suppkey % 5 AS w, CAST(0.5 AS DOUBLE) + s_suppkey % 3 AS h FROM supplier WHERE s_nationkey NOT IN (0, 3, 7))
SELECT DISTINCT cell FROM g JOIN b ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h""",
}
