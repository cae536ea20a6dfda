"""Plans over the daily, monthly and annual tables and the monthly cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import columns as C
from gridlark.operators import daily as D
from gridlark.operators import tables as T
from gridlark.plans.inputs import CUBE, DAILY, MONTHLY, as_text, cube, daily, r6, rounded, table

FIRST, LAST = 1995, 2000


def monthly(spark, sf_dir):
    return T.monthly(daily(spark, sf_dir), "value", "total")


def monthly_area(spark, sf_dir):
    return rounded(monthly(spark, sf_dir), "value_days", "total_days", "mean_daily")


def annual_peak(spark, sf_dir):
    return rounded(T.annual(monthly(spark, sf_dir), "value_days", "n_days"), "value_days", "peak_value", "mean_daily")


def annual_median(spark, sf_dir):
    a = T.annual(T.full_years(monthly(spark, sf_dir)), "value_days", "n_days")
    return a.agg(r6(F.median("value_days")).alias("median_value"), F.count("*").alias("n"))


def month_spine_zero_fill(spark, sf_dir):
    """Months with too few days count as not there; all that aren't become zero."""
    m = monthly(spark, sf_dir).where("n_days >= 25")
    return rounded(T.filled_months(m, ["value_days", "n_days"], 1995, 2001), "value_days")


def day_spine_conditional_fill(spark, sf_dir):
    """Days without a value are absent, and filled up as the series' rules tell."""
    d = daily(spark, sf_dir).where("value > 0")
    return rounded(T.filled_days(d, "day", ["total"], {"value": 1997}, "1996-01-01", "1998-12-31"), "total", "value")


def missing_months(spark, sf_dir):
    expected = T.year_months(spark, 1995, 2001)
    return T.missing(expected, monthly(spark, sf_dir), ["year", "month"])


def climatology_quartiles(spark, sf_dir):
    return rounded(T.climatology(monthly(spark, sf_dir), "value_days"), "median", "q25", "q75")


def year_coverage(spark, sf_dir):
    return T.coverage(monthly(spark, sf_dir))


def skip_partial(spark, sf_dir):
    m = T.full_years(monthly(spark, sf_dir))
    return m.groupBy("year").agg(r6(F.sum("value_days")).alias("value_days"))


def greedy_peaks(spark, sf_dir):
    m = monthly(spark, sf_dir).select(C.month_start(F.col("year"), F.col("month")).alias("day"), r6("value_days").alias("value_days"))
    return T.greedy_peaks(m, "day", "value_days")


def _by_month(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return m.where(F.col("year").between(FIRST, LAST))


def seasonality(spark, sf_dir):
    got = T.seasonality(_by_month(spark, sf_dir), "value_days", 1998)
    return rounded(got, "mean", "share_of_year", "early_mean", "late_mean", "change", "share_of_change")


def season_halves(spark, sf_dir):
    got = T.seasonality(_by_month(spark, sf_dir), "value_days", 1998)
    part = F.col("month").between(7, 9)
    return got.agg(r6(F.sum("early_mean")).alias("early_total"), r6(F.sum("late_mean")).alias("late_total"), r6(F.sum(F.when(part, F.col("early_mean"))) / F.sum("early_mean")).alias("early_share"), r6(F.sum(F.when(part, F.col("late_mean"))) / F.sum("late_mean")).alias("late_share"))


def centroid(spark, sf_dir):
    return rounded(T.centroid(_by_month(spark, sf_dir), "value_days"), "centroid_day")


def yearly_values(spark, sf_dir):
    return _by_month(spark, sf_dir).groupBy("year").agg(F.sum("value_days").alias("v"))


def last_years_share(spark, sf_dir):
    y = yearly_values(spark, sf_dir)
    return y.agg(r6(F.sum(F.when(F.col("year") > LAST - 2, F.col("v"))) / F.sum("v")).alias("last_share"), r6(F.lit(2.0) / F.count("*")).alias("share_of_years"))


def rank_years(spark, sf_dir):
    from pyspark.sql import Window as W

    y = yearly_values(spark, sf_dir)
    return y.select("year", r6("v").alias("v"), F.rank().over(W.orderBy(F.col("v").desc())).alias("rank"))


def half_means(spark, sf_dir):
    return rounded(T.halves(yearly_values(spark, sf_dir), "v", "year"), "early_mean", "late_mean", "ratio", "welch_t", "welch_df")


def cell_year_frequency(spark, sf_dir):
    sums = D.accumulate(cube(spark, sf_dir), ["year", "cell"])
    return sums.select("year", "cell", r6(F.when(F.col("b") >= 100, 100 * C.ratio("d", "b"))).alias("pct"))


def annual_table(spark, sf_dir):
    c = cube(spark, sf_dir)
    got = D.thin_out(c, "b", 20, ["b", "d", "c"], to_zero=True)
    sums = got.groupBy("year").agg(F.sum("d").alias("flag_sum"), F.sum("b").alias("valid_sum"), F.sum("c").alias("value_sum"))
    out = sums.join(T.coverage(c), "year")
    return out.select("year", r6("flag_sum").alias("flag_sum"), r6("valid_sum").alias("valid_sum"), r6("value_sum").alias("value_sum"), "months", "span", "partial", r6(100 * C.ratio("flag_sum", "valid_sum")).alias("pct"), r6(C.ratio("value_sum", "valid_sum")).alias("flag_index"), r6(C.ratio("value_sum", "flag_sum")).alias("mean_flagged"))


def flag_days(spark, sf_dir):
    return rounded(T.cell_days(cube(spark, sf_dir)), "flag_days")


def domain_every_year(spark, sf_dir):
    return T.domain(cube(spark, sf_dir).where("cell % 4 <> 1 or year <> 1999"), FIRST, LAST)


def _domain_cube(spark, sf_dir):
    c = cube(spark, sf_dir)
    return c.join(T.domain(c, FIRST, LAST), "cell", "left_semi")


_RATIOS = ("a", "b", "c", "d", "fraction", "flag_index", "mean_value", "intensity", "background")


def domain_monthly(spark, sf_dir):
    got = T.series_ratios(_domain_cube(spark, sf_dir), ["year", "month"])
    return rounded(got.withColumn("days", F.col("fraction") * C.days_in_month(F.col("year"), F.col("month"))), *_RATIOS, "days")


def domain_annual(spark, sf_dir):
    m = T.series_ratios(_domain_cube(spark, sf_dir), ["year", "month"]).withColumn("days", F.col("fraction") * C.days_in_month(F.col("year"), F.col("month")))
    days = m.groupBy("year").agg(F.sum("days").alias("days"), F.count("*").alias("n_months"))
    return rounded(T.series_ratios(m, ["year"]).join(days, "year"), *_RATIOS, "days")


def merged_monthly(spark, sf_dir):
    """Both products by month: an inner join on year and month, cut to a window and sorted."""
    m = T.series_ratios(cube(spark, sf_dir), ["year", "month"]).select("year", "month", r6("fraction").alias("fraction"))
    h = monthly(spark, sf_dir).select("year", "month", r6("value_days").alias("value_days"))
    joined = m.join(h, ["year", "month"]).where("year >= 1997")
    return joined.orderBy("year", "month")


def period_mean_diff(spark, sf_dir):
    c = cube(spark, sf_dir).groupBy("cell", "year").agg(F.floor(F.sum("d") / 100).cast("double").alias("days"))
    return rounded(T.period_means(c, (1995, 1996), (1999, 2000)), "early", "late", "change", "early_mean", "late_mean")


def window_frequency_change(spark, sf_dir):
    return rounded(T.window_change(cube(spark, sf_dir), (1995, 1997), (1998, 2000), 2000), "early_pct", "late_pct", "change_pp")


def window_summary(spark, sf_dir):
    w = T.window_change(cube(spark, sf_dir), (1995, 1997), (1998, 2000), 2000)
    return w.agg(F.count("*").alias("cells"), r6(100.0 * F.avg((F.col("change_pp") > 0).cast("double"))).alias("rising_pct"), r6(F.min("change_pp")).alias("least"), r6(F.max("change_pp")).alias("most"), r6(F.percentile("change_pp", 0.98)).alias("p98"), r6(F.percentile("change_pp", 0.02)).alias("p02"))


def diagnostics(spark, sf_dir):
    c = cube(spark, sf_dir).where("year = 1998").withColumn("idx", F.when(F.col("b") > 50, C.ratio("c", "b")))
    return D.diagnostics(c, "idx", "b")


def rules():
    return {
        "negative": F.col("a") < 0,
        "out_of_range": F.col("d") / F.nullif(F.col("b"), F.lit(0.0)) > 0.9,
        "subset": F.col("d") > F.col("b"),
        "month": ~F.col("month").between(1, 12),
        "late": F.col("year") > 2000,
    }


def validate_rules(spark, sf_dir):
    return D.violations(cube(spark, sf_dir), rules())


def bounding(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell"]).withColumn("row", F.floor(F.col("cell") / 5).cast("int")).withColumn("col", (F.col("cell") % 5).cast("int"))
    return rounded(D.bounding_box(c.withColumn("v", F.when((F.col("row") > 0) & (F.col("col") < 4), F.col("a"))), "v", "b"), "median_weight")


def region_split(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell", "year"]).withColumn("region", C.region(F.lit(-125.0) + F.col("cell") * 2.0))
    by = c.where(F.col("year").between(FIRST, LAST)).groupBy("region", "year").agg(F.avg("a").alias("v"))
    e, l = F.avg(F.when(F.col("year") < 1998, F.col("v"))), F.avg(F.when(F.col("year") >= 1998, F.col("v")))
    return by.groupBy("region").agg(r6(F.avg("v")).alias("mean"), r6(e).alias("early"), r6(l).alias("late"), r6(l / e).alias("ratio"), F.max_by("year", F.struct("v", -F.col("year"))).alias("peak_year"))


THRESHOLDS = (50, 200, 1000, 2000, 3000)


def tail_shares(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell", "year"])
    return rounded(T.tail_shares(c, "d", THRESHOLDS), *[f"share_ge_{t}" for t in THRESHOLDS])


def tail_summary(spark, sf_dir):
    """By threshold: mean share, both halves, their ratio, and the year with the largest."""
    got = T.tail_summary(D.accumulate(cube(spark, sf_dir), ["cell", "year"]), "d", THRESHOLDS)
    return rounded(got, "mean_percent", "early_percent", "late_percent", "ratio", "max_percent")


def coverage_bins(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell"])
    med = c.agg(F.median("b").alias("m"))
    q = c.crossJoin(F.broadcast(med)).withColumn("bin", C.binned(F.col("b") / F.col("m"), [0, 0.9, 0.97, 1.03, 1.1, 5]))
    return q.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("a")).alias("mean"))


def step_contrast(spark, sf_dir):
    m = T.series_ratios(cube(spark, sf_dir), ["year", "month"])
    one, two = F.col("year") == 1995, F.col("year").between(1997, 1998)
    p = lambda c: F.sum(F.when(c, F.col("b"))) / F.count_if(c)
    return m.agg(r6(p(one)).alias("before"), r6(p(two)).alias("after"), r6(100 * (p(two) / p(one) - 1)).alias("increase_pct"))


def top_cells(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell", "year"]).select("cell", "year", F.round("d", 2).alias("d"))
    return T.top(c, 15, F.col("d").desc(), F.col("year"), F.col("cell"))


def bottom_months(spark, sf_dir):
    m = T.series_ratios(cube(spark, sf_dir), ["year", "month"]).select("year", "month", r6("b").alias("b"))
    return T.top(m, 5, F.col("b"), F.col("year"), F.col("month"))


def top_full_years(spark, sf_dir):
    y = T.full_years(cube(spark, sf_dir)).groupBy("year").agg(r6(C.ratio(F.sum("d"), F.sum("b"))).alias("fraction"))
    return T.top(y, 4, F.col("fraction").desc(), F.col("year"))


def pooled_percentiles(spark, sf_dir):
    c = D.accumulate(cube(spark, sf_dir), ["cell", "year"])
    return c.agg(r6(F.percentile("a", 0.99)).alias("p99"), r6(F.percentile("a", 0.995)).alias("p995"), r6(F.percentile("a", 0.02)).alias("p02"), F.ceil(F.max("a")).cast("long").alias("ceiling"))


def scattered(spark, sf_dir):
    cells = spark.range(30).select(F.col("id").cast("int").alias("cell"))
    got = D.accumulate(cube(spark, sf_dir), ["cell"]).select("cell", r6("a").alias("a"))
    return cells.join(got, "cell", "left")


def grid_check(spark, sf_dir):
    """The cells of two products, customers' and suppliers', compared: some only one has, some lie a little apart."""
    at = lambda name, key, shift: table(spark, sf_dir, name).select(F.col(key).alias("id"), (F.col(key) * 25.0 + shift).alias("x"), (F.col(key) * 2.0).alias("y"))
    return T.same_grid(at("customer", "c_custkey", F.lit(0.0)), at("supplier", "s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, 0.5).otherwise(0.0)), "id", ["x", "y"])


def strided(spark, sf_dir):
    return T.strided(monthly(spark, sf_dir).select((F.col("year") * 100 + F.col("month")).alias("ym"), "n_days"), "ym", 2)


QUERIES = {f.__name__: f for f in (
    monthly_area, annual_peak, annual_median, month_spine_zero_fill, day_spine_conditional_fill, missing_months, climatology_quartiles, year_coverage, skip_partial, greedy_peaks,
    seasonality, season_halves, centroid, last_years_share, rank_years, half_means, cell_year_frequency, annual_table, flag_days, domain_every_year, domain_monthly, domain_annual,
    merged_monthly, period_mean_diff, window_frequency_change, window_summary, diagnostics, validate_rules, region_split, tail_shares, tail_summary, coverage_bins, step_contrast, top_cells,
    bottom_months, top_full_years, pooled_percentiles, scattered, grid_check, strided,
)} | {"bounding_box": bounding}

M = f"WITH {MONTHLY}"
Q = f"WITH {CUBE}"
FULL = "full_years AS (SELECT year FROM {0} GROUP BY year HAVING count(DISTINCT month) = 12)"
SPAN = f"year BETWEEN {FIRST} AND {LAST}"
SEASON = f"""{M}, s AS (SELECT month, avg(value_days) AS mean, avg(CASE WHEN year < 1998 THEN value_days END) AS early_mean,
  avg(CASE WHEN year >= 1998 THEN value_days END) AS late_mean FROM monthly WHERE {SPAN} GROUP BY month)"""
YR = f"{M}, y AS (SELECT year, sum(value_days) AS v FROM monthly WHERE {SPAN} GROUP BY year)"
DOMAIN = f"""{Q}, seen AS (SELECT cell, year FROM cube WHERE {SPAN} GROUP BY ALL HAVING sum(b) > 0),
domain AS (SELECT cell FROM seen GROUP BY cell HAVING count(*) = 6), dc AS (SELECT * FROM cube WHERE cell IN (SELECT cell FROM domain))"""
SERIES = """round(sum(a), 6) AS a, round(sum(b), 6) AS b, round(sum(c), 6) AS c, round(sum(d), 6) AS d, round(sum(d) / nullif(sum(b), 0), 6) AS fraction,
  round(sum(c) / nullif(sum(b), 0), 6) AS flag_index, round(sum(a) / nullif(sum(b), 0), 6) AS mean_value, round(sum(c) / nullif(sum(d), 0), 6) AS intensity,
  round((sum(a) - sum(c)) / nullif(sum(b) - sum(d), 0), 6) AS background"""
CHANGE = f"""{Q}, w AS (SELECT cell, sum(CASE WHEN year BETWEEN 1995 AND 1997 THEN d ELSE 0 END) AS d0, sum(CASE WHEN year BETWEEN 1995 AND 1997 THEN b ELSE 0 END) AS b0,
  sum(CASE WHEN year BETWEEN 1998 AND 2000 THEN d ELSE 0 END) AS d1, sum(CASE WHEN year BETWEEN 1998 AND 2000 THEN b ELSE 0 END) AS b1 FROM cube GROUP BY cell),
ch AS (SELECT cell, 100 * d0 / nullif(b0, 0) AS early_pct, 100 * d1 / nullif(b1, 0) AS late_pct, 100 * d1 / nullif(b1, 0) - 100 * d0 / nullif(b0, 0) AS change_pp FROM w WHERE b0 >= 2000 AND b1 >= 2000)"""

ORACLES = {
    "greedy_peaks": f"""{M}, m AS (SELECT make_date(year, month, 1) AS day, round(value_days, 6) AS v FROM monthly), p1 AS (SELECT * FROM m ORDER BY v DESC, day LIMIT 1),
p2 AS (SELECT m.* FROM m, p1 WHERE abs(date_diff('day', p1.day, m.day)) >= 183 ORDER BY m.v DESC, m.day LIMIT 1),
p3 AS (SELECT m.* FROM m, p1, p2 WHERE abs(date_diff('day', p1.day, m.day)) >= 183 AND abs(date_diff('day', p2.day, m.day)) >= 183 ORDER BY m.v DESC, m.day LIMIT 1)
SELECT CAST(1 AS INT) AS rank, day, v AS value FROM p1 UNION ALL SELECT 2, day, v FROM p2 UNION ALL SELECT 3, day, v FROM p3""",
    "monthly_area": f"{M} SELECT year, month, round(value_days, 6) AS value_days, n_days, round(total_days, 6) AS total_days, round(mean_daily, 6) AS mean_daily FROM monthly",
    "annual_peak": f"""{M} SELECT year, round(sum(value_days), 6) AS value_days, CAST(sum(n_days) AS BIGINT) AS n_days, round(max(value_days), 6) AS peak_value,
  CAST(arg_max(month, value_days) AS INT) AS peak_month, round(sum(value_days) / CASE WHEN year % 4 = 0 THEN 366 ELSE 365 END, 6) AS mean_daily FROM monthly GROUP BY year""",
    "annual_median": f"{M}, {FULL.format('monthly')}, y AS (SELECT year, sum(value_days) AS v FROM monthly WHERE year IN (SELECT year FROM full_years) GROUP BY year) SELECT round(median(v), 6) AS median_value, count(*) AS n FROM y",
    "month_spine_zero_fill": f"""{M}, spine AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1995, 2002) a(y), range(1, 13) b(m))
SELECT year, month, round(coalesce(value_days, 0), 6) AS value_days, coalesce(n_days, 0) AS n_days FROM spine LEFT JOIN (SELECT * FROM monthly WHERE n_days >= 25) USING (year, month)""",
    "day_spine_conditional_fill": f"""WITH {DAILY}, spine AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, round(coalesce(total, 0), 6) AS total, round(CASE WHEN year(day) >= 1997 THEN coalesce(value, 0) ELSE value END, 6) AS value
FROM spine LEFT JOIN (SELECT * FROM daily WHERE value > 0) USING (day)""",
    "missing_months": f"{M} SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1995, 2002) a(y), range(1, 13) b(m) WHERE (y, m) NOT IN (SELECT (year, month) FROM monthly)",
    "climatology_quartiles": f"{M} SELECT month, round(median(value_days), 6) AS median, round(quantile_cont(value_days, 0.25), 6) AS q25, round(quantile_cont(value_days, 0.75), 6) AS q75 FROM monthly GROUP BY month",
    "year_coverage": f"{M} SELECT year, count(DISTINCT month) AS months, min(month) AS first, max(month) AS last, count(DISTINCT month) < 12 AS partial, min(month) || '-' || max(month) AS span FROM monthly GROUP BY year",
    "skip_partial": f"{M}, {FULL.format('monthly')} SELECT year, round(sum(value_days), 6) AS value_days FROM monthly WHERE year IN (SELECT year FROM full_years) GROUP BY year",
    "seasonality": f"""{SEASON} SELECT month, round(mean, 6) AS mean, round(mean / sum(mean) OVER (), 6) AS share_of_year, round(early_mean, 6) AS early_mean, round(late_mean, 6) AS late_mean,
  round(late_mean - early_mean, 6) AS change, round((late_mean - early_mean) / sum(late_mean - early_mean) OVER (), 6) AS share_of_change, late_mean - early_mean < 0 AS declining FROM s""",
    "season_halves": f"""{SEASON} SELECT round(sum(early_mean), 6) AS early_total, round(sum(late_mean), 6) AS late_total, round(sum(early_mean) FILTER (month BETWEEN 7 AND 9) / sum(early_mean), 6) AS early_share,
  round(sum(late_mean) FILTER (month BETWEEN 7 AND 9) / sum(late_mean), 6) AS late_share FROM s""",
    "centroid": f"{M} SELECT year, round(sum(dayofyear(make_date(2003, month, 15)) * (greatest(value_days, 0) + 1e-12)) / sum(greatest(value_days, 0) + 1e-12), 6) AS centroid_day FROM monthly WHERE {SPAN} GROUP BY year",
    "last_years_share": f"{YR} SELECT round(sum(v) FILTER (year > {LAST - 2}) / sum(v), 6) AS last_share, round(CAST(2 AS DOUBLE) / count(*), 6) AS share_of_years FROM y",
    "rank_years": f"{YR} SELECT year, round(v, 6) AS v, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS rank FROM y",
    "half_means": f"""{YR}, k AS (SELECT v, row_number() OVER (ORDER BY year) <= count(*) OVER () // 2 AS early FROM y),
h AS (SELECT avg(v) FILTER (early) AS e, avg(v) FILTER (NOT early) AS l, var_samp(v) FILTER (early) / count(*) FILTER (early) AS ve, var_samp(v) FILTER (NOT early) / count(*) FILTER (NOT early) AS vl,
  count(*) FILTER (early) AS ne, count(*) FILTER (NOT early) AS nl FROM k)
SELECT round(e, 6) AS early_mean, round(l, 6) AS late_mean, round(l / e, 6) AS ratio, round((e - l) / sqrt(ve + vl), 6) AS welch_t, round((ve + vl) ** 2 / (ve ** 2 / (ne - 1) + vl ** 2 / (nl - 1)), 6) AS welch_df FROM h""",
    "cell_year_frequency": f"{Q} SELECT year, cell, round(CASE WHEN sum(b) >= 100 THEN 100 * (sum(d) / nullif(sum(b), 0)) END, 6) AS pct FROM cube GROUP BY ALL",
    "annual_table": f"""{Q}, t AS (SELECT year, month, CASE WHEN b >= 20 THEN b ELSE 0 END AS b, CASE WHEN b >= 20 THEN c ELSE 0 END AS c, CASE WHEN b >= 20 THEN d ELSE 0 END AS d FROM cube)
SELECT year, round(sum(d), 6) AS flag_sum, round(sum(b), 6) AS valid_sum, round(sum(c), 6) AS value_sum, count(DISTINCT month) AS months, min(month) || '-' || max(month) AS span,
  count(DISTINCT month) < 12 AS partial, round(100 * (sum(d) / nullif(sum(b), 0)), 6) AS pct, round(sum(c) / nullif(sum(b), 0), 6) AS flag_index, round(sum(c) / nullif(sum(d), 0), 6) AS mean_flagged FROM t GROUP BY year""",
    "flag_days": f"{Q} SELECT year, cell, round(sum(coalesce(d / nullif(b, 0), 0) * day(last_day(make_date(year, month, 1)))), 6) AS flag_days FROM cube GROUP BY ALL",
    "domain_every_year": f"{Q}, seen AS (SELECT cell, year FROM cube WHERE (cell % 4 <> 1 OR year <> 1999) AND {SPAN} GROUP BY ALL HAVING sum(b) > 0) SELECT cell FROM seen GROUP BY cell HAVING count(*) = 6",
    "domain_monthly": f"{DOMAIN} SELECT year, month, {SERIES}, round(sum(d) / nullif(sum(b), 0) * day(last_day(make_date(year, month, 1))), 6) AS days FROM dc GROUP BY year, month",
    "domain_annual": f"""{DOMAIN}, m AS (SELECT year, month, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, sum(d) / nullif(sum(b), 0) * day(last_day(make_date(year, month, 1))) AS days FROM dc GROUP BY year, month)
SELECT year, {SERIES}, round(sum(days), 6) AS days, count(*) AS n_months FROM m GROUP BY year""",
    "merged_monthly": f"""WITH {CUBE}, {MONTHLY}, m AS (SELECT year, month, round(sum(d) / nullif(sum(b), 0), 6) AS fraction FROM cube GROUP BY ALL)
SELECT year, month, fraction, round(value_days, 6) AS value_days FROM m JOIN monthly USING (year, month) WHERE year >= 1997""",
    "period_mean_diff": f"""{Q}, y AS (SELECT cell, year, floor(sum(d) / 100) AS days FROM cube GROUP BY ALL), p AS (SELECT cell, sum(CASE WHEN year BETWEEN 1995 AND 1996 THEN days ELSE 0 END) / 2 AS e,
  sum(CASE WHEN year BETWEEN 1999 AND 2000 THEN days ELSE 0 END) / 2 AS l FROM y GROUP BY cell)
SELECT cell, round(nullif(e, 0), 6) AS early, round(nullif(l, 0), 6) AS late, round(l - e, 6) AS change, round(avg(e) OVER (), 6) AS early_mean, round(avg(l) OVER (), 6) AS late_mean FROM p""",
    "window_frequency_change": f"{CHANGE} SELECT cell, round(early_pct, 6) AS early_pct, round(late_pct, 6) AS late_pct, round(change_pp, 6) AS change_pp FROM ch",
    "window_summary": f"""{CHANGE} SELECT count(*) AS cells, round(100 * avg(CASE WHEN change_pp > 0 THEN 1.0 ELSE 0 END), 6) AS rising_pct, round(min(change_pp), 6) AS least, round(max(change_pp), 6) AS most,
  round(quantile_cont(change_pp, 0.98), 6) AS p98, round(quantile_cont(change_pp, 0.02), 6) AS p02 FROM ch""",
    "diagnostics": f"""{Q}, i AS (SELECT b, CASE WHEN b > 50 THEN c / nullif(b, 0) END AS idx FROM cube WHERE year = 1998)
SELECT count(idx) AS covered, round(CAST(100 AS DOUBLE) * count(idx) / count(*), 5) AS covered_pct, round(median(idx), 5) AS median_value, round(quantile_cont(idx, 0.99), 5) AS p99_value, round(avg(idx), 5) AS mean_value,
  round(max(idx), 5) AS max_value, round(sum(b), 5) AS total_weight FROM i""",
    "validate_rules": f"""{Q}, r AS (SELECT 'negative' AS rule, count(*) FILTER (a < 0) AS n FROM cube UNION ALL SELECT 'out_of_range', count(*) FILTER (d / nullif(b, 0) > 0.9) FROM cube
  UNION ALL SELECT 'subset', count(*) FILTER (d > b) FROM cube UNION ALL SELECT 'month', count(*) FILTER (month NOT BETWEEN 1 AND 12) FROM cube UNION ALL SELECT 'late', count(*) FILTER (year > 2000) FROM cube)
SELECT rule, n FROM r WHERE n > 0""",
    "bounding_box": f"""{Q}, s AS (SELECT cell, cell // 5 AS row, cell % 5 AS col, sum(a) AS a, sum(b) AS b FROM cube GROUP BY ALL)
SELECT min(row) FILTER (row > 0 AND col < 4) AS min_row, max(row) FILTER (row > 0 AND col < 4) AS max_row, min(col) FILTER (row > 0 AND col < 4) AS min_col, max(col) FILTER (row > 0 AND col < 4) AS max_col, round(median(b), 6) AS median_weight FROM s""",
    "region_split": f"""{Q}, s AS (SELECT cell, year, sum(a) AS a FROM cube WHERE {SPAN} GROUP BY ALL), g AS (SELECT CASE WHEN -125 + cell * 2 < -105 THEN 'West' WHEN -125 + cell * 2 < -90 THEN 'Central' ELSE 'East' END AS region, year, avg(a) AS v FROM s GROUP BY ALL)
SELECT region, round(avg(v), 6) AS mean, round(avg(v) FILTER (year < 1998), 6) AS early, round(avg(v) FILTER (year >= 1998), 6) AS late, round(avg(v) FILTER (year >= 1998) / avg(v) FILTER (year < 1998), 6) AS ratio, arg_max(year, v) AS peak_year FROM g GROUP BY region""",
    "tail_shares": f"""{Q}, s AS (SELECT cell, year, sum(d) AS d FROM cube GROUP BY ALL)
SELECT year, {', '.join(f'CAST(round(avg(CASE WHEN d >= {t} THEN 1.0 ELSE 0 END), 6) AS DOUBLE) AS share_ge_{t}' for t in THRESHOLDS)} FROM s GROUP BY year""",
    "tail_summary": f"""{Q}, s AS (SELECT cell, year, sum(d) AS d FROM cube GROUP BY ALL), p AS (SELECT CAST(t AS DOUBLE) AS threshold, year, 100 * avg(CASE WHEN d >= t THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p FROM s, (SELECT unnest({list(THRESHOLDS)}) AS t) GROUP BY ALL),
h AS (SELECT list_sort(list(DISTINCT year)) AS y FROM s), g AS (SELECT p.*, year < y[len(y) // 2 + 1] AS early FROM p, h)
SELECT threshold, round(avg(p), 6) AS mean_percent, round(avg(p) FILTER (early), 6) AS early_percent, round(avg(p) FILTER (NOT early), 6) AS late_percent, round(avg(p) FILTER (NOT early) / greatest(avg(p) FILTER (early), 1e-9), 6) AS ratio,
  arg_max(year, p - year * 1e-9) AS max_year, round(max(p), 6) AS max_percent FROM g GROUP BY threshold""",
    "coverage_bins": f"""{Q}, s AS (SELECT cell, sum(a) AS a, sum(b) AS b FROM cube GROUP BY ALL), q AS (SELECT a, b / (SELECT median(b) FROM s) AS q FROM s)
SELECT CAST(CASE WHEN q < 0 THEN NULL WHEN q < 0.9 THEN 0 WHEN q < 0.97 THEN 1 WHEN q < 1.03 THEN 2 WHEN q < 1.1 THEN 3 WHEN q < 5 THEN 4 END AS INT) AS bin, count(*) AS n, round(avg(a), 6) AS mean FROM q GROUP BY ALL""",
    "step_contrast": f"""{Q}, m AS (SELECT year, month, sum(b) AS b FROM cube GROUP BY ALL), p AS (SELECT sum(b) FILTER (year = 1995) / count(*) FILTER (year = 1995) AS one, sum(b) FILTER (year BETWEEN 1997 AND 1998) / count(*) FILTER (year BETWEEN 1997 AND 1998) AS two FROM m)
SELECT round(one, 6) AS before, round(two, 6) AS after, round(100 * (two / one - 1), 6) AS increase_pct FROM p""",
    "top_cells": f"{Q}, s AS (SELECT cell, year, round(sum(d), 2) AS d FROM cube GROUP BY ALL) SELECT cell, year, d FROM s ORDER BY d DESC, year, cell LIMIT 15",
    "bottom_months": f"{Q} SELECT year, month, round(sum(b), 6) AS b FROM cube GROUP BY ALL ORDER BY b, year, month LIMIT 5",
    "top_full_years": f"{Q}, {FULL.format('cube')} SELECT year, round(sum(d) / nullif(sum(b), 0), 6) AS fraction FROM cube WHERE year IN (SELECT year FROM full_years) GROUP BY year ORDER BY fraction DESC, year LIMIT 4",
    "pooled_percentiles": f"{Q}, s AS (SELECT sum(a) AS a FROM cube GROUP BY cell, year) SELECT round(quantile_cont(a, 0.99), 6) AS p99, round(quantile_cont(a, 0.995), 6) AS p995, round(quantile_cont(a, 0.02), 6) AS p02, CAST(ceil(max(a)) AS BIGINT) AS ceiling FROM s",
    "scattered": f"{Q}, s AS (SELECT cell, round(sum(a), 6) AS a FROM cube GROUP BY cell) SELECT CAST(i AS INT) AS cell, a FROM range(30) g(i) LEFT JOIN s ON s.cell = i",
    "grid_check": """SELECT count(*) FILTER (c_custkey IS NULL OR s_suppkey IS NULL) AS unmatched, count(*) FILTER (c_custkey IS NOT NULL AND s_suppkey % 7 = 0) AS differing
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
    "strided": f"{M}, k AS (SELECT year * 100 + month AS ym, n_days, row_number() OVER (ORDER BY year * 100 + month) AS k FROM monthly) SELECT ym, n_days FROM k WHERE (k - 1) % 2 = 0",
}

as_text(QUERIES, ORACLES, {"day_spine_conditional_fill": ("day",), "greedy_peaks": ("day",)})
