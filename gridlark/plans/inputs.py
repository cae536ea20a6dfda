"""The library's tables out of the driver's: each plan reads what its role needs, and its SQL starts from the same definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.columns import SCALE, masks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> object:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sightings: user is the pixel, one in forty pixels shares a cell, errors are flagged, sign-ups aren't valid."""
    e = table(spark, sf_dir, "events")
    valid = F.col("event_type") != "signup"
    return e.select(
        F.col("user_id").alias("pixel"), (F.col("user_id") % 40).cast("int").alias("cell"), F.to_date("ts").alias("day"), F.col("value").alias("obs"),
        valid.alias("valid"), (valid & (F.col("event_type") == "error")).alias("flagged"),
    )


OBS = """obs AS (SELECT user_id AS pixel, CAST(user_id % 40 AS INT) AS cell, CAST(ts AS DATE) AS day, value AS obs,
  event_type <> 'signup' AS valid, event_type = 'error' AS flagged FROM events)"""


def words(spark: SparkSession, sf_dir: str, quality=(0,)) -> DataFrame:
    """events with a 16-bit quality word and a raw value in thousandths, a tenth of them the fill value."""
    e = table(spark, sf_dir, "events")
    word = ((F.col("event_id") * 40503) % 65536).cast("int")
    raw = F.when(F.col("event_id") % 10 == 0, -28672).otherwise(F.floor("value")).cast("int")
    df = e.select("event_id", F.col("user_id").alias("pixel"), F.to_date("ts").alias("day"), word.alias("word"), raw.alias("raw"))
    valid, flagged = masks(F.col("raw"), F.col("word"), quality)
    return df.select("*", (F.col("raw") * SCALE).alias("obs"), valid.alias("valid"), flagged.alias("flagged"))


def words_sql(quality: str = "0") -> str:
    return f"""raw AS (SELECT event_id, user_id AS pixel, CAST(ts AS DATE) AS day, CAST((event_id * 40503) % 65536 AS INT) AS word,
  CAST(CASE WHEN event_id % 10 = 0 THEN -28672 ELSE floor(value) END AS INT) AS raw FROM events),
fields AS (SELECT *, (word >> 3) & 3 AS surface, (word >> 8) & 15 AS quality, (word >> 13) & 3 AS model FROM raw),
words AS (SELECT *, raw * CAST(0.001 AS DOUBLE) AS obs, surface = 0 AND quality IN ({quality}) AND raw >= 0 AS valid,
  surface = 0 AND quality IN ({quality}) AND raw >= 0 AND model = 1 AS flagged FROM fields)"""


CELLS = 25


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the monthly cube: supplier groups are cells, price and quantity the sums, returns the flagged part."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_returnflag") == "R"
    keys = [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_suppkey") % CELLS).cast("int").alias("cell")]
    return li.groupBy(*keys).agg(
        (F.sum("l_extendedprice") / 1000).alias("a"), F.sum("l_quantity").alias("b"),
        (F.sum(F.when(part, F.col("l_extendedprice")).otherwise(0.0)) / 1000).alias("c"), F.sum(F.when(part, F.col("l_quantity")).otherwise(0.0)).alias("d"),
    )


CUBE = """cube AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, CAST(l_suppkey % 25 AS INT) AS cell,
  sum(l_extendedprice) / 1000 AS a, sum(l_quantity) AS b, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / 1000 AS c,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS d FROM lineitem GROUP BY ALL)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the daily table: urgent orders' prices are the value, all prices the total."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    urgent = F.col("o_orderpriority").startswith("1")
    return o.groupBy("day").agg((F.sum(F.when(urgent, F.col("o_totalprice")).otherwise(0.0)) / 1000).alias("value"), (F.sum("o_totalprice") / 1000).alias("total"))


DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END) / 1000 AS value,
  sum(o_totalprice) / 1000 AS total FROM orders GROUP BY ALL)"""

MONTHLY = DAILY + """, monthly AS (SELECT CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, sum(value) AS value_days,
  count(*) FILTER (value > 0) AS n_days, sum(total) AS total_days, sum(value) / day(last_day(min(day))) AS mean_daily FROM daily GROUP BY ALL)"""


def yearly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual matrix of the full years: root of the revenue by cell and year."""
    c = cube(spark, sf_dir)
    return c.where("year between 1995 and 2000").groupBy("cell", "year").agg(F.sqrt(F.sum("a")).alias("v"))


YEARLY = CUBE + ", yearly AS (SELECT cell, year, sqrt(sum(a)) AS v FROM cube WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL)"


def as_text(queries: dict, oracles: dict, dates: dict[str, tuple[str, ...]]) -> None:
    """Dates leave a query as ISO text on both sides, so that clients with different date types see the same values."""
    for name, columns in dates.items():
        run = queries[name]
        queries[name] = lambda spark, sf_dir, run=run, columns=columns: (df := run(spark, sf_dir)).withColumns({c: df[c].cast("string") for c in columns})
        if name in oracles:
            replaced = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
            oracles[name] = f"SELECT * REPLACE ({replaced}) FROM ({oracles[name]})"
