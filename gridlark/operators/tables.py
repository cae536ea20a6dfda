"""Spines, versions, periods, seasons and rankings over the monthly and annual tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.functions.columns import days_in_month, days_in_year_by_four, mid_month_day, ratio

# ---- de-duplication ------------------------------------------------------------------------------------------------------


def latest(df: DataFrame, keys: Sequence[str], version: str, seq: str) -> DataFrame:
    """The newest version of each key: first seen among equals; place: the key's first appearance."""
    best = df.groupBy(*keys).agg(F.min(seq).alias("place"), F.max_by(F.struct(*df.columns), F.struct(F.col(version), -F.col(seq))).alias("_row"))
    return best.select("_row.*", "place")


def first_of_name(df: DataFrame, name: str, seq: str) -> DataFrame:
    """One row for each exact name, the first seen."""
    return df.groupBy(name).agg(F.min_by(F.struct(*df.columns), seq).alias("_row")).select("_row.*")


# ---- spines --------------------------------------------------------------------------------------------------------------


def year_months(spark: SparkSession, first: int, last: int) -> DataFrame:
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def filled_months(df: DataFrame, values: Sequence[str], first: int, last: int) -> DataFrame:
    """Every month from first to last year; months without a row are explicit zeros."""
    spine = year_months(df.sparkSession, first, last)
    return spine.join(df, ["year", "month"], "left").select("year", "month", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])


def filled_days(df: DataFrame, day: str, always: Sequence[str], since: dict[str, int], first: str, last: str) -> DataFrame:
    """Every day; the columns in always are zero where absent, those in since only from their first year on and null before."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day))
    known = {c: F.when(F.year(day) >= y, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c, y in since.items()}
    joined = spine.join(df, day, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in always} | known).select(day, *always, *since)


def fixed_columns(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    """The columns of a layout (name to type) in its order: those that df lacks are null, those that the layout lacks go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in layout.items()])


def class_columns(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], names: dict[str, str]) -> DataFrame:
    """One row a key with a column for each class and value: names gives the new name of each value, in which {} stands for the class."""
    wide = df.groupBy(*keys).pivot(kind, list(kinds)).agg(*[F.first(c).alias(c) for c in names])
    return wide.select(*keys, *[F.col(f"{k}_{c}" if len(names) > 1 else k).alias(n.format(k)) for c, n in names.items() for k in kinds])


def missing(expected: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(found.select(*on).distinct(), list(on), "left_anti")


def unfinished(members: DataFrame, finished: DataFrame, on: Sequence[str]) -> DataFrame:
    """Members that no earlier run has finished."""
    return missing(members, finished, on)


def same_grid(a: DataFrame, b: DataFrame, key: str, coords: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: cells that only one side has, and cells whose coordinates differ; both are zero for equal grids."""
    both = a.alias("a").join(b.alias("b"), key, "full")
    lone = F.col(f"a.{coords[0]}").isNull() | F.col(f"b.{coords[0]}").isNull()
    apart = F.lit(False)
    for c in coords:
        apart = apart | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance)
    return both.agg(F.count_if(lone).alias("unmatched"), F.count_if(F.coalesce(apart, F.lit(False))).alias("differing"))


# ---- months and years ----------------------------------------------------------------------------------------------------


def monthly(daily: DataFrame, value: str, total: str) -> DataFrame:
    """Sum and number of positive days of a value, sum of the total, and the mean over the calendar days of the month."""
    y, m = F.year("day").alias("year"), F.month("day").alias("month")
    sums = daily.groupBy(y, m).agg(
        F.sum(value).alias("value_days"), F.count_if(F.col(value) > 0).alias("n_days"), F.sum(total).alias("total_days")
    )
    return sums.withColumn("mean_daily", F.col("value_days") / days_in_month(F.col("year"), F.col("month")))


def annual(months: DataFrame, value: str, n_days: str) -> DataFrame:
    """Sum, days, largest month, mean a day and the earliest month that reaches the largest value."""
    return (
        months.groupBy("year")
        .agg(
            F.sum(value).alias("value_days"),
            F.sum(n_days).alias("n_days"),
            F.max(value).alias("peak_value"),
            F.max_by("month", F.struct(F.col(value), -F.col("month"))).alias("peak_month"),
        )
        .withColumn("mean_daily", F.col("value_days") / days_in_year_by_four(F.col("year")))
    )


def full_years(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Rows of years that have all twelve months."""
    whole = df.groupBy(year).agg(F.count_distinct(month).alias("_n")).where("_n = 12").select(year)
    return df.join(whole, year, "left_semi")


def coverage(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Months of each year, first and last, and a label; partial: fewer than twelve."""
    got = df.groupBy(year).agg(F.count_distinct(month).alias("months"), F.min(month).alias("first"), F.max(month).alias("last"))
    return got.withColumn("partial", F.col("months") < 12).withColumn("span", F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))


def cell_days(cube: DataFrame) -> DataFrame:
    """Flag frequency in days a month: fraction (zero where nothing was seen) times the days of the month, summed by year."""
    days = F.coalesce(ratio("d", "b"), F.lit(0.0)) * days_in_month(F.col("year"), F.col("month"))
    return cube.groupBy("year", "cell").agg(F.sum(days).alias("flag_days"))


def domain(cube: DataFrame, first: int, last: int) -> DataFrame:
    """Cells observed in every year of the window; a year without rows counts as not observed."""
    seen = cube.where(F.col("year").between(first, last)).groupBy("cell", "year").agg(F.sum("b").alias("w")).where("w > 0")
    return seen.groupBy("cell").agg(F.count("*").alias("years")).where(F.col("years") == last - first + 1).select("cell")


def series_ratios(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over all cells first, ratios afterwards; mean of the flagged values is undefined without any."""
    sums = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("a", "b", "c", "d")])
    a, b, c, d = (F.col(x) for x in "abcd")
    return sums.select(
        *keys, "a", "b", "c", "d",
        ratio(d, b).alias("fraction"), ratio(c, b).alias("flag_index"), ratio(a, b).alias("mean_value"), ratio(c, d).alias("intensity"), ratio(a - c, b - d).alias("background"),
    )


def window_change(cube: DataFrame, early: tuple[int, int], late: tuple[int, int], least: float) -> DataFrame:
    """Frequency in percent in two windows by cell and its change; cells below the least weight in either window drop out."""
    part = lambda c, w: F.sum(F.when(F.col("year").between(*w), F.col(c)).otherwise(0.0))
    sums = cube.groupBy("cell").agg(part("d", early).alias("d0"), part("b", early).alias("b0"), part("d", late).alias("d1"), part("b", late).alias("b1"))
    kept = sums.where((F.col("b0") >= least) & (F.col("b1") >= least))
    return kept.select("cell", (100 * ratio("d0", "b0")).alias("early_pct"), (100 * ratio("d1", "b1")).alias("late_pct")).withColumn(
        "change_pp", F.col("late_pct") - F.col("early_pct")
    )


def period_means(counts: DataFrame, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """Mean a year by cell in two periods: field without true zeros, difference with them, domain means over all cells."""
    span = lambda w: w[1] - w[0] + 1
    part = lambda w: F.sum(F.when(F.col("year").between(*w), F.col("days")).otherwise(0.0)) / span(w)
    means = counts.groupBy("cell").agg(part(early).alias("early"), part(late).alias("late"))
    totals = means.agg(F.avg("early").alias("early_mean"), F.avg("late").alias("late_mean"))
    return means.crossJoin(F.broadcast(totals)).select(  # totals: one row
        "cell", F.nullif("early", F.lit(0.0)).alias("early"), F.nullif("late", F.lit(0.0)).alias("late"), (F.col("late") - F.col("early")).alias("change"),
        "early_mean", "late_mean",
    )


def climatology(df: DataFrame, value: str) -> DataFrame:
    q = [F.percentile(value, p).alias(n) for n, p in (("q25", 0.25), ("q75", 0.75))]
    return df.groupBy("month").agg(F.median(value).alias("median"), *q)


def seasonality(df: DataFrame, value: str, split_year: int) -> DataFrame:
    """By month: mean, its share of the year, early and late means, and the month's share of the change."""
    by = df.groupBy("month").agg(
        F.avg(value).alias("mean"),
        F.avg(F.when(F.col("year") < split_year, F.col(value))).alias("early_mean"),
        F.avg(F.when(F.col("year") >= split_year, F.col(value))).alias("late_mean"),
    )
    by = by.withColumn("change", F.col("late_mean") - F.col("early_mean"))
    totals = by.agg(F.sum("mean").alias("_m"), F.sum("change").alias("_c"))  # one row, over twelve
    return by.crossJoin(F.broadcast(totals)).select(
        "month", "mean", (F.col("mean") / F.col("_m")).alias("share_of_year"), "early_mean", "late_mean", "change",
        ratio("change", "_c").alias("share_of_change"), (F.col("change") < 0).alias("declining"),
    )


def centroid(df: DataFrame, value: str) -> DataFrame:
    """Weighted mean day of the year; negative values count as zero and a trace keeps empty years defined."""
    w = F.greatest(F.col(value), F.lit(0.0)) + 1e-12
    return df.groupBy("year").agg((F.sum(mid_month_day(F.col("month")) * w) / F.sum(w)).alias("centroid_day"))


def halves(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: means of the first and last half (an odd count gives the longer one to the last), their ratio and Welch's t."""
    n = df.agg(F.count("*").alias("_n"))
    numbered = df.withColumn("_k", F.row_number().over(W.orderBy(order)))  # a series of years: some dozens of rows
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    e, l = F.when(early, F.col(value)), F.when(~early, F.col(value))
    got = numbered.crossJoin(F.broadcast(n)).agg(
        F.avg(e).alias("early_mean"), F.avg(l).alias("late_mean"),
        (F.var_samp(e) / F.count(e)).alias("_ve"), (F.var_samp(l) / F.count(l)).alias("_vl"), F.count(e).alias("n_early"), F.count(l).alias("n_late"),
    )
    df_ = (F.col("_ve") + F.col("_vl")) ** 2 / (F.col("_ve") ** 2 / (F.col("n_early") - 1) + F.col("_vl") ** 2 / (F.col("n_late") - 1))
    return got.select(
        "early_mean", "late_mean", ratio("late_mean", "early_mean").alias("ratio"),
        ((F.col("early_mean") - F.col("late_mean")) / F.sqrt(F.col("_ve") + F.col("_vl"))).alias("welch_t"), df_.alias("welch_df"),
    )


def tail_shares(counts: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of the cells that reach each threshold, by year."""
    return counts.groupBy("year").agg(*[F.avg((F.col(value) >= t).cast("double")).alias(f"share_ge_{t:g}") for t in thresholds])


def tail_summary(counts: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """By threshold: mean percent of cells that reach it, of the first and the second half of the years (a middle year belongs to
    the second) and their ratio, and the first year with the largest percent."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    shares = counts.select("year", value, each).groupBy("threshold", "year").agg((100 * F.avg((F.col(value) >= F.col("threshold")).cast("double"))).alias("p"))
    half = counts.select("year").distinct().groupBy().agg(F.array_sort(F.collect_list("year")).alias("_y")).select(F.expr("get(_y, size(_y) div 2)").alias("_half"))  # one row a year
    split = shares.crossJoin(F.broadcast(half))  # one row
    means = split.groupBy("threshold").agg(
        F.avg("p").alias("mean_percent"), F.avg(F.when(F.col("year") < F.col("_half"), F.col("p"))).alias("early_percent"), F.avg(F.when(F.col("year") >= F.col("_half"), F.col("p"))).alias("late_percent"),
        F.max(F.struct("p", (-F.col("year")).alias("k"))).alias("_top"),
    )
    ratio_of = F.col("late_percent") / F.greatest("early_percent", F.lit(1e-9))
    return means.select("threshold", "mean_percent", "early_percent", "late_percent", ratio_of.alias("ratio"), (-F.col("_top.k")).alias("max_year"), F.col("_top.p").alias("max_percent"))


def greedy_peaks(df: DataFrame, day: str, value: str, keep: int = 3, apart: int = 183) -> DataFrame:
    """Highest values that lie at least `apart` days from each higher one kept; ties go to the earlier day.

    Each choice is a maximum over the days that all choices before it leave, so it takes `keep` passes over the days' highest
    values; no window and no array holds the series. The choices, `keep` rows at most, come to the driver between passes.
    """
    left = df.where(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.max(value).alias("value"))
    picked = []
    while len(picked) < keep:
        best = left.agg(F.max(F.struct("value", (-F.unix_date("day")).alias("k"), "day")).alias("x")).select("x.day", "x.value").first()
        if best["day"] is None:
            break
        picked.append((len(picked) + 1, best["day"], best["value"]))
        left = left.where(F.abs(F.date_diff("day", F.lit(best["day"]))) >= apart)
    kind = df.schema[value].dataType.simpleString()
    return df.sparkSession.createDataFrame(picked, f"rank int, day date, value {kind}")


def mid_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def strided(df: DataFrame, order: str, step: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.orderBy(order))).where((F.col("_k") - 1) % step == 0).drop("_k")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones for the same seed however the rows are partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
