"""From single observations to cell sums and ratios: collapse first, add sums, divide last."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import ratio

SUMS = ("a", "b", "c", "d")


def collapse(obs: DataFrame, keys: Sequence[str], value: str, valid: str, flagged: str) -> DataFrame:
    """One row a pixel and day: a mean valid value, b 1 if any is valid, c mean flagged value, d 1 if any is flagged; else 0.

    Repeated sightings count once. One shuffle on the keys, with partial sums before it.
    """
    v, s = F.col(valid), F.col(flagged)
    return obs.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(v, F.col(value))), F.lit(0.0)).alias("a"),
        F.max(F.when(v, 1.0).otherwise(0.0)).alias("b"),
        F.coalesce(F.avg(F.when(s, F.col(value))), F.lit(0.0)).alias("c"),
        F.max(F.when(s, 1.0).otherwise(0.0)).alias("d"),
    )


def located(pixels: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pixels with their cell; pixels that the lookup table lacks are dropped. Spark chooses the join by the table's size."""
    return pixels.join(lookup, list(on), "inner")


def accumulate(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of a to d, with the same weights for each, by cell and whatever else is in keys."""
    return pixels.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def merged(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Partial sums of several runs added up: any split of the days gives the same totals."""
    return accumulate(reduce(lambda x, y: x.unionByName(y), parts), keys)


def ratios(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratios of sums with their weights; undefined where the weight is zero."""
    return sums.select(
        *keys,
        ratio("a", "b").alias("mean_value"),
        ratio("c", "d").alias("mean_flagged"),
        ratio("c", "b").alias("flag_index"),
        ratio("d", "b").alias("flag_fraction"),
        F.col("b").alias("valid_weight"),
        F.col("d").alias("flag_weight"),
    )


def day_counts(obs: DataFrame, keys: Sequence[str], day: str, when: Column) -> DataFrame:
    """Different days with at least one sighting, by key: a cell that many sightings hit counts one day."""
    return obs.where(when).groupBy(*keys).agg(F.count_distinct(day).alias("days"))


def useful(lookup: DataFrame, part: str) -> DataFrame:
    """Parts (tiles) of which the lookup table keeps any pixel, with their number of pixels."""
    return lookup.groupBy(part).agg(F.count("*").alias("pixels")).where("pixels > 0")


def thin_out(df: DataFrame, weight: str, least: float, values: Sequence[str], to_zero: bool = False) -> DataFrame:
    """Rows below the least weight have their values set to null, or to zero where sums go on."""
    keep = F.col(weight) >= least
    return df.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(0.0) if to_zero else F.lit(None).cast("double")) for c in values})


def diagnostics(cube: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: covered cells, their share, median, 99th percentile, mean and largest value, total weight; to five digits."""
    r = lambda c: F.round(c, 5)
    return cube.agg(
        F.count(value).alias("covered"),
        r(100.0 * F.count(value) / F.nullif(F.count("*"), F.lit(0))).alias("covered_pct"),
        r(F.median(value)).alias("median_value"),
        r(F.percentile(value, 0.99)).alias("p99_value"),
        r(F.avg(value)).alias("mean_value"),
        r(F.max(value)).alias("max_value"),
        r(F.sum(weight)).alias("total_weight"),
    )


def violations(cube: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): every rule that some rows break, and by how many; one pass for all rules, nothing stops at the first."""
    counted = cube.agg(F.count("*").alias("_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    pairs = [F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules]
    pairs.append(F.struct(F.lit("empty").alias("rule"), F.when(F.col("_rows") == 0, 1).otherwise(0).cast("long").alias("n")))
    return counted.select(F.inline(F.array(*pairs))).where("n > 0")


def bounding_box(cells: DataFrame, value: str, weight: str) -> DataFrame:
    """First and last row and column with a value, and the median of the positive weights."""
    seen = F.col(value).isNotNull()
    ends = [f(F.when(seen, F.col(c))).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))]
    return cells.agg(*ends, F.median(F.when(F.col(weight) > 0, F.col(weight))).alias("median_weight"))
