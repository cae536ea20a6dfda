"""An extension: daily partial sums kept up to date by a stream of observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlark.operators.daily import accumulate
from gridlark.sources.store import write_partials


def daily_partials(
    spark: SparkSession, source: str, schema: str, to_pixels: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, day: str = "day", keys: Sequence[str] = ("cell",)
) -> StreamingQuery:
    """Files that arrive under source become partial sums by day, each batch in one directory of its own.

    The batch number is part of the path, so a batch that runs again after a failure overwrites itself; readers add the
    batches up. A day's observations must arrive in one batch, as files of whole days do. Runs until the backlog is done.
    """

    def put(batch: DataFrame, number: int) -> None:
        write_partials(accumulate(to_pixels(batch), [day, *keys]), f"{path}/batch={number}", day)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_sums(stream: DataFrame, ts: str, value: str, key: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Sums by key and calendar day of a stream; observations later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def latest_versions(stream: DataFrame, keys: Sequence[str], version: str, seq: str) -> DataFrame:
    """Of each key the row with the highest version, of equal ones the first, kept as state and sent anew when it changes."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), F.struct(F.col(version), -F.col(seq))).alias("_r")).select(*keys, "_r.*")
