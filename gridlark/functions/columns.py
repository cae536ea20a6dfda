"""Column helpers: bit fields, null-safe ratios, calendar arithmetic, versioned file names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The quality word's fields as (shift, mask), and the codes that count.
SURFACE, QUALITY, MODEL = (3, 0b11), (8, 0b1111), (13, 0b11)
LAND, EVENT_MODEL, BEST, PERMISSIVE = 0, 1, (0,), (0, 11)
SCALE = 0.001

#: product.AyyyyDDD.hHHvVV.collection.production, with or without its ending
NAME = r"^({0})\.A(\d{{4}})(\d{{3}})\.h(\d{{2}})v(\d{{2}})\.(\d{{3}})\.(\d{{13}})(?:\.hdf)?$"
PRODUCT = "MCD19A2"


def bits(word: Column, field: tuple[int, int]) -> Column:
    """A bit field of an integer word."""
    return F.shiftright(word, field[0]).bitwiseAND(F.lit(field[1]))


def masks(raw: Column, word: Column, quality: Iterable[int] = BEST) -> tuple[Column, Column]:
    """(valid, flagged): land, a listed quality and a value that isn't negative; flagged is the part of valid with the event model."""
    valid = (bits(word, SURFACE) == LAND) & bits(word, QUALITY).isin(*quality) & (raw >= 0)
    return valid, valid & (bits(word, MODEL) == EVENT_MODEL)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null (undefined, not zero) where b is zero or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def no_nan(c: Column) -> Column:
    """NaN becomes null, so that aggregates skip it and sorts don't put it last."""
    return F.when(~F.isnan(c), c)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(year, month)))


def days_in_year_by_four(year: Column) -> Column:
    """366 in every year divisible by four; calendar-true from 1901 to 2099 only."""
    return F.when(year % 4 == 0, 366).otherwise(365)


def date_of_day(year: Column, day: Column) -> Column:
    """The date of a day of the year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day.cast("int") - 1)


def mid_month_day(month: Column) -> Column:
    """Day of the year of the month's fifteenth, in a common year."""
    return F.dayofyear(F.make_date(F.lit(2003), month, F.lit(15)))


def stamp(text: Column) -> Column:
    """'yyyyDDD HHmm' in UTC as a timestamp; null for anything else."""
    return F.try_to_timestamp(text, F.lit("yyyyDDD HHmm"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month DATE, last_day DATE, label) of every month from 'YYYY-MM' to 'YYYY-MM', both included."""
    every = F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month")))
    return spark.range(1).select(every.alias("month")).select("month", F.last_day("month").alias("last_day"), F.date_format("month", "yyyy-MM").alias("label"))


def parsed_name(name: str, product: str = PRODUCT) -> Column:
    """struct(year, doy, h, v, collection, production, tile, day) of a product's file name, bare name, or url that ends with one; others raise."""
    base, pattern = F.substring_index(F.col(name), "/", -1), NAME.format(product)
    part = lambda k: F.regexp_extract(base, pattern, k)
    number = lambda k, kind="int": F.nullif(part(k), F.lit("")).cast(kind)
    fields = F.struct(
        number(2).alias("year"), number(3).alias("doy"), number(4).alias("h"), number(5).alias("v"), part(6).alias("collection"),
        number(7, "long").alias("production"), F.concat(F.lit("h"), part(4), F.lit("v"), part(5)).alias("tile"), date_of_day(number(2), number(3)).alias("day"),
    )
    return F.when(base.rlike(pattern), fields).otherwise(F.raise_error(F.concat(F.lit("not a granule name: "), F.coalesce(base, F.lit("null")))))


def nested_name(record: str, link: str) -> Column:
    """The name in a nested record, or where it has none the last part of a link."""
    return F.coalesce(F.nullif(F.col(record), F.lit("")), F.substring_index(F.col(link), "/", -1))


def month_list(spark: SparkSession, labels: Iterable[str]) -> DataFrame:
    """(month DATE, last_day DATE, label) of the listed 'YYYY-MM', in the order given and each once."""
    rows = [(k, m) for k, m in enumerate(dict.fromkeys(labels))]
    listed = spark.createDataFrame(rows, "at int, label string").withColumn("month", F.to_date(F.concat("label", F.lit("-01"))))
    return listed.orderBy("at").select("month", F.last_day("month").alias("last_day"), "label")


def titled(text: Column) -> Column:
    """A category label without blanks around it and with a capital initial."""
    return F.initcap(F.trim(text))


def size_mb(size: Column, unit: Column) -> Column:
    """A size in megabytes from a number and its unit; unknown units count as megabytes."""
    u = F.upper(F.trim(unit))
    return size * F.when(u == "KB", 1 / 1024).when(u == "GB", 1024.0).otherwise(1.0)


def region(lon: Column, west: float = -105.0, central: float = -90.0) -> Column:
    return F.when(lon < west, "West").when(lon < central, "Central").otherwise("East")


def binned(value: Column, edges: list[float]) -> Column:
    """Number of the half-open interval [edges[k], edges[k + 1]) that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = F.when((value >= lo) & (value < hi), k).otherwise(out)
    return out
