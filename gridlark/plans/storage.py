"""Plans that write and read back: partial sums, run records, checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.operators import daily as D
from gridlark.plans.core import _SUM, COLLAPSE, SUMS, pixels
from gridlark.plans.inputs import OBS, rounded, table
from gridlark.session import scratch
from gridlark.sources import store


def partials_on_disk(spark, sf_dir):
    """Daily partials written in two runs, the second of which repeats some days, read back and added up."""
    by_day = D.accumulate(pixels(spark, sf_dir), ["day", "cell"])
    path = scratch(spark)
    store.write_partials(by_day.where("dayofmonth(day) <= 20"), path)
    store.write_partials(by_day.where("dayofmonth(day) > 15"), path)
    return rounded(D.accumulate(store.read_partials(spark, path), ["cell"]), *SUMS)


def manifest_collate(spark, sf_dir):
    """Run records of the months of orders, written one file a month with a field that readers don't know and an unreadable file among them."""
    path = scratch(spark)
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.dayofmonth("o_orderdate").alias("d"))
    months = o.groupBy("month").agg(F.count_distinct("d").alias("days"), F.count("*").alias("granules"))
    records = months.select("month", F.when(F.col("days") > 27, "complete").otherwise("partial").alias("status"), "days", "granules", F.lit("x").alias("unknown"))
    store.write_records(records, path)
    months.limit(1).select(F.lit("{broken").alias("value")).coalesce(1).write.mode("append").text(path)
    return store.read_records(spark, path).select("month", "status", "days", "granules")


def checksum_verify(spark, sf_dir):
    """Files by market segment against a list in which one has another content and one isn't there."""
    path = scratch(spark)
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    segments.select(F.col("segment").alias("value"), "segment").repartition("segment").write.partitionBy("segment").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    found = files.select(F.regexp_extract("path", "segment=([^/]+)/", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    text = F.when(F.col("segment") == "BUILDING", F.lit("changed")).otherwise(F.col("segment"))
    listed = segments.select(F.col("segment").alias("name"), F.sha2(F.concat(text, F.lit("\n")).cast("binary"), 256).alias("sha256"))
    return store.verified(found, listed.unionByName(spark.range(1).select(F.lit("absent").alias("name"), F.lit("0").alias("sha256"))))


QUERIES = {f.__name__: f for f in (partials_on_disk, manifest_collate, checksum_verify)}
ORACLES = {
    "partials_on_disk": f"WITH {OBS}, {COLLAPSE} SELECT cell, {_SUM} FROM px GROUP BY cell",
    "manifest_collate": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT day(o_orderdate)) AS days, count(*) AS granules FROM orders GROUP BY 1)
SELECT month, CASE WHEN days > 27 THEN 'complete' ELSE 'partial' END AS status, days, granules FROM m""",
    "checksum_verify": "SELECT c_mktsegment AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'differs' ELSE 'ok' END AS state FROM customer GROUP BY ALL UNION ALL SELECT 'absent', 'missing'",
}
