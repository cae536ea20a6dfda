"""Streams over files of the given tables: days that come in several batches, versions out of order, windowed sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.operators.daily import SUMS
from gridlark.plans.core import COLLAPSE
from gridlark.plans.inputs import OBS, observations, rounded, table
from gridlark.session import scratch
from gridlark.sources import store
from gridlark.streaming import partials, versions


def _files(df, path: str, batches: int, by) -> None:
    """df as files of several batches, which a stream reads one after the other."""
    for k in range(batches):
        df.where(F.pmod(by, F.lit(batches)) == k).coalesce(2).write.mode("append").parquet(path)


def late_days(spark, sf_dir):
    """Every day's observations come in three batches, one of which is added twice; the days' sums are those of all at once."""
    obs, path = observations(spark, sf_dir).withColumn("_k", F.xxhash64("pixel", "day", "obs")), scratch(spark)
    _files(obs, f"{path}/in", 3, F.col("_k"))
    keys = ["pixel", "cell"]
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")

    def put(batch, number):
        part = versions.sightings(batch, ["day", *keys], "obs", "valid", "flagged")
        for _ in range(2 if number == 1 else 1):  # a replay, as after a failure
            versions.upsert(batch.sparkSession, part, number, f"{path}/days", keys)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    got = versions.collapsed(versions.read_days(spark, f"{path}/days"), ["day", *keys])
    return rounded(got.groupBy("cell").agg(*[F.sum(c).alias(c) for c in SUMS]), *SUMS)


def streamed_versions(spark, sf_dir):
    """Latest version of each key of a stream that brings versions out of order, from its keyed state's output."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    rows = li.groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = rows.withColumn("v", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.col("l_orderkey").alias("key"), ((F.col("p") + 7 * F.col("v")) % 11).alias("version"), (F.col("l_orderkey") * 3 + F.col("v")).alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("v") * 60).alias("ts"), (F.col("s") + F.col("v")).alias("payload"),
    )
    path = scratch(spark)
    _files(rows, f"{path}/in", 3, F.col("seq"))
    before = {k: spark.conf.get(k, None) for k in versions.STATE_STORE}
    try:
        for k, v in versions.STATE_STORE.items():
            spark.conf.set(k, v)
        stream = versions.latest_versions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), ["key"], "version", "seq", "ts")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    sent = spark.read.schema(rows.schema).parquet(f"{path}/out")  # a key's rows in the order of their versions; the last one stands
    return sent.groupBy("key").agg(F.max_by(F.struct("version", "seq", "payload"), F.struct("version", (-F.col("seq")).alias("s"))).alias("r")).select("key", "r.*")


def windowed_days(spark, sf_dir):
    """Sums by type and day of a stream of events with a watermark."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    path = scratch(spark)
    _files(e, f"{path}/in", 3, F.col("event_id"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    sums = partials.windowed_sums(stream, "ts", "value", "event_type", late="40 days")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    last = store.read_partials(spark, f"{path}/out").groupBy("w", "event_type").agg(F.max_by(F.struct("total", "n"), "batch").alias("r"))
    return rounded(last.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "r.*"), "total")


QUERIES = {f.__name__: f for f in (late_days, streamed_versions, windowed_days)}

ORACLES = {
    "late_days": f"WITH {OBS}, {COLLAPSE} SELECT cell, {', '.join(f'round(CAST(sum({c}) AS DOUBLE), 6) AS {c}' for c in SUMS)} FROM px GROUP BY cell",
    "streamed_versions": """WITH r AS (SELECT l_orderkey AS key, max(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
v AS (SELECT key, (p + 7 * v) % 11 AS version, key * 3 + v AS seq, s + v AS payload FROM r, range(3) t(v)) SELECT key, version, seq, payload FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, seq) = 1""",
    "windowed_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY ALL",
}
