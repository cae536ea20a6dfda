"""Latest versions of a stream as keyed state that expires, and daily partial sums that arrive in several batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

#: What keyed state needs; other stores don't keep timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Groups of keys that share a call and a state value, so that a call handles many keys at once; a stream's checkpoint fixes it.
BUCKETS = 1024


class LatestVersion(StatefulProcessor):
    """Of a key's rows the one with the highest version, of equal ones the first in sequence; sent when it changes.

    A key's state is dropped when no row of it has come for `keep` milliseconds of event time. Later rows of it begin anew.
    A state value holds the keys of one bucket as arrays, with a timer for the first of them to expire.
    """

    def __init__(self, keys: Sequence[StructField], columns: Sequence[str], keep: int):
        self.fields, self.keys, self.columns, self.keep = list(keys), [f.name for f in keys], list(columns), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        numbers = [StructField(n, ArrayType(LongType())) for n in ("by_version", "by_seq", "by_until")]
        self.known = handle.getValueState("known", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.fields] + numbers))

    def _load(self) -> pd.DataFrame:
        names = [*self.keys, "by_version", "by_seq", "by_until"]
        old = self.known.get() if self.known.exists() else [[] for _ in names]
        types = [object] * len(self.keys) + ["int64"] * 3
        return pd.DataFrame({n: pd.Series(list(v), dtype=t) for n, v, t in zip(names, old, types)})

    def _store(self, rows: pd.DataFrame, before: int | None, watermark: int) -> None:
        """Keeps the rows whose time isn't over; before: the timer that is set, if any."""
        rows = rows[rows["by_until"] > watermark]
        due = int(rows["by_until"].min()) if len(rows) else None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.known.clear()
        else:
            self.known.update(tuple(rows[n].tolist() for n in [*self.keys, "by_version", "by_seq", "by_until"]))

    def _best(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first of each key's rows by version and sequence, of equal ones the first in order, with its key's latest time."""
        until = rows.groupby(self.keys, sort=False, dropna=False)["by_until"].transform("max")
        return rows.assign(by_until=until).sort_values(["by_version", "by_seq"], ascending=[False, True], kind="stable").drop_duplicates(self.keys)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self._load()
        best = old.assign(by_new=False)
        for part in rows:
            part = part.assign(by_until=part["by_at"] + self.keep, by_new=True).astype({k: object for k in self.keys})
            best = self._best(pd.concat([best, part], ignore_index=True) if len(best) else part)
        self._store(best, int(old["by_until"].min()) if len(old) else None, timerValues.getCurrentWatermarkInMs())
        sent = best[best["by_new"].astype(bool)]
        if len(sent):
            yield sent[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._store(self._load(), None, now)  # the timer that called is gone
        return iter(())

    def close(self) -> None:
        pass


def latest_versions(
    stream: DataFrame, keys: Sequence[str], version: str, seq: str, ts: str, late: str = "1 day", keep: int = 86_400_000, buckets: int = BUCKETS
) -> DataFrame:
    """The stream's rows that are the latest version of their key when they come (append output); state lives for `keep` ms of event time.

    Needs the settings of STATE_STORE. Rows later than `late` are dropped by the watermark, so with keep no shorter than that a
    key's state outlives all rows that can still come for its last one. A null version comes before all others, a null
    sequence after.
    """
    # Python calls lose names that begin with an underscore. Whole numbers pass pandas as text, where nulls beside them don't make them floats.
    text = lambda f: isinstance(f.dataType, IntegralType)
    passed = [F.col(f.name).cast("string").alias(f.name) if text(f) else F.col(f.name) for f in stream.schema]
    schema = StructType([StructField(f.name, StringType() if text(f) else f.dataType) for f in stream.schema])
    ranks = [
        F.coalesce(F.col(version).cast("long"), F.lit(-(1 << 63))).alias("by_version"), F.coalesce(F.col(seq).cast("long"), F.lit((1 << 63) - 1)).alias("by_seq"),
        F.unix_millis(ts).alias("by_at"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("by_bucket"),
    ]
    rows = stream.withWatermark(ts, late).select(*passed, *ranks)
    processor = LatestVersion([schema[k] for k in keys], stream.columns, keep)
    sent = rows.groupBy("by_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return sent.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if text(f) else F.col(f.name) for f in stream.schema])


# ---- partial sums of days that arrive in several batches ---------------------------------------------------------------


def sightings(obs: DataFrame, keys: Sequence[str], value: str, valid: str, flagged: str) -> DataFrame:
    """Sums by pixel and day that can be added to later ones, unlike means: values and their number, valid and flagged."""
    v, s = F.col(valid), F.col(flagged)
    sums = {"value_sum": F.when(v, F.col(value)), "valid_n": v.cast("long"), "flagged_sum": F.when(s, F.col(value)), "flagged_n": s.cast("long")}
    return obs.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


SIGHTINGS = ("value_sum", "valid_n", "flagged_sum", "flagged_n")


def collapsed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What daily.collapse gives for all observations of a day, from the sums of all its batches."""
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)
    seen = lambda n: (F.col(n) > 0).cast("double")
    return rows.select(*keys, mean("value_sum", "valid_n").alias("a"), seen("valid_n").alias("b"), mean("flagged_sum", "flagged_n").alias("c"), seen("flagged_n").alias("d"))


def read_days(spark: SparkSession, path: str, day: str = "day", but: Column | None = None) -> DataFrame | None:
    """The latest version of every day under a path, with its ledger of batches; None where nothing has been written yet.

    Versions and days are folders, so finding the latest ones reads no data.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    found = spark.read.option("basePath", path).parquet(path)
    found = found.where(but) if but is not None else found
    latest = found.groupBy(day).agg(F.max("version").alias("version"))
    return found.join(latest, [day, "version"], "left_semi")


def upsert(spark: SparkSession, batch: DataFrame, number: int, path: str, keys: Sequence[str], sums: Sequence[str] = SIGHTINGS, day: str = "day") -> None:
    """Adds a batch of sums by day and keys to the days under a path. A batch may come again: each counts once.

    A day that the batch touches is written anew as version=<number>/day=<day>, from its latest other version. Its ledger lists
    the batches that are in it; where it has the number already, the day stays as it is. Days that aren't touched aren't read.
    """
    fresh = batch.groupBy(day, *keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("ledger", F.array(F.lit(number).cast("long")))
    old = read_days(spark, path, day, F.col("version") != number)
    if old is not None:
        touched = fresh.select(day).distinct()
        old = old.join(touched, day, "left_semi").drop("version")
        done = old.where(F.array_contains("ledger", F.lit(number).cast("long"))).select(day).distinct()
        rows = old.select(day, *keys, *sums, "ledger").unionByName(fresh).join(done, day, "left_anti")
        ledgers = rows.groupBy(day).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ledger")))).alias("ledger"))
        fresh = rows.groupBy(day, *keys).agg(*[F.sum(c).alias(c) for c in sums]).join(ledgers, day)
    fresh.write.mode("overwrite").partitionBy(day).parquet(f"{path}/version={number}")


def day_sums(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sums: Sequence[str] = SIGHTINGS, day: str = "day") -> StreamingQuery:
    """Keeps the days under a path up to date with a stream of sums; runs until the backlog is done."""
    put = lambda batch, number: upsert(batch.sparkSession, batch, number, path, keys, sums, day)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
