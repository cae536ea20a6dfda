"""Streams with keyed state and days that arrive in several batches: out of order, restarted, replayed, expired."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import daily as D
from gridlark.streaming import versions as S

SCHEMA = "tile string, version long, seq long, ts timestamp, name string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def state(spark):
    before = {k: spark.conf.get(k, None) for k in S.STATE_STORE}
    for k, v in S.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(spark, tmp_path, files, keep=3 * 86_400_000):
    """Adds files of rows one batch each, restarting the query from its checkpoint for every one; the rows sent so far."""
    out = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.latest_versions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["tile"], "version", "seq", "ts", "1 hour", keep)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append({(r.tile, r.name) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()})
    return out


def test_latest_versions_out_of_order_and_restarted(state, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    files = [
        [("h1", 5, 1, at(0), "a"), ("h1", 9, 2, at(0), "b"), ("h2", 3, 3, at(0), "c"), ("h2", 3, 4, at(0), "d")],
        [("h1", 7, 5, at(0), "late"), ("h2", 4, 6, at(1), "e"), ("h3", 1, 7, at(1), "f")],
        [("h2", 4, 8, at(1), "equal"), ("h1", 10, 9, at(1), "g")],
    ]
    got = run(state, tmp_path, files)
    assert got == [{("h1", "b"), ("h2", "c")}, {("h1", "b"), ("h2", "c"), ("h2", "e"), ("h3", "f")}, {("h1", "b"), ("h2", "c"), ("h2", "e"), ("h3", "f"), ("h1", "g")}]


def test_latest_versions_expire(state, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    hours = 3_600_000
    files = [
        [("h1", 9, 1, at(0), "a")],
        [("h2", 1, 2, at(5), "b")],  # the watermark passes the time until which h1 was kept
        [("h2", 1, 3, at(9), "same")],  # ... and its timer has run in this batch at the latest
        [("h1", 2, 4, at(9), "anew"), ("h2", 0, 5, at(9), "older")],
    ]
    got = run(state, tmp_path, files, keep=2 * hours)
    assert ("h1", "anew") in got[-1] and ("h2", "older") not in got[-1]
    assert not any(name == "anew" for _, name in got[2])


def observations(rng, n):
    return [(rng.randrange(6), rng.randrange(3), dt.date(2024, 1, 1 + rng.randrange(3)), rng.random() < 0.7, rng.random() < 0.4, rng.randrange(500) / 1000) for _ in range(n)]


def test_days_in_several_batches_and_replays(spark, tmp_path):
    """A day in three batches, one of them replayed twice, equals all observations at once."""
    rng, path = random.Random(5), str(tmp_path / "days")
    schema = "pixel int, cell int, day date, valid boolean, flagged boolean, obs double"
    batches = [spark.createDataFrame([r[:4] + (r[3] and r[4], r[5]) for r in observations(rng, 60)], schema) for _ in range(3)]
    keys = ["pixel", "cell"]
    sums = [S.sightings(b, ["day", *keys], "obs", "valid", "flagged") for b in batches]
    for number in (0, 1, 1, 2, 1, 0):
        S.upsert(spark, sums[number], number, path, keys)
    assert S.read_days(spark, str(tmp_path / "nothing")) is None
    got = S.read_days(spark, path)
    assert {tuple(r.ledger) for r in got.select("ledger").distinct().collect()} == {(0, 1, 2)}
    have = S.collapsed(got, ["day", *keys])
    want = D.collapse(batches[0].union(batches[1]).union(batches[2]), ["day", *keys], "obs", "valid", "flagged")
    rows = lambda df: sorted((str(r.day), r.pixel, r.cell, *(round(r[c], 9) for c in D.SUMS)) for r in df.collect())
    assert rows(have) == rows(want)


def test_untouched_days_stay(spark, tmp_path):
    path, schema = str(tmp_path / "days"), "day date, cell int, n long"
    day = lambda d, *n: spark.createDataFrame([(dt.date(2024, 1, d), k, v) for k, v in enumerate(n)], schema)
    S.upsert(spark, day(1, 1, 2), 0, path, ["cell"], ["n"])
    S.upsert(spark, day(2, 5), 1, path, ["cell"], ["n"])
    S.upsert(spark, day(1, 10), 2, path, ["cell"], ["n"])
    got = {(r.day.day, r.cell): (r.n, r.version, tuple(r.ledger)) for r in S.read_days(spark, path).collect()}
    assert got == {(1, 0): (11, 2, (0, 2)), (1, 1): (2, 2, (0, 2)), (2, 0): (5, 1, (1,))}
    plan = S.read_days(spark, path).where(F.col("day") == "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan and "PartitionFilters" in plan


def test_stream_of_day_sums(spark, tmp_path):
    schema = "day date, cell int, n long"
    for k in range(3):
        spark.createDataFrame([(dt.date(2024, 1, 1), 0, 10**k), (dt.date(2024, 1, 2 + k), 1, 7)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        S.day_sums(stream, str(tmp_path / "days"), str(tmp_path / "check"), ["cell"], ["n"]).awaitTermination()
    got = {(r.day.day, r.cell): r.n for r in S.read_days(spark, str(tmp_path / "days")).collect()}
    assert got == {(1, 0): 111, (2, 1): 7, (3, 1): 7, (4, 1): 7}


def test_latest_versions_many_keys_share_a_call(state, tmp_path):
    """Thousands of keys in two batches within seconds (a call for each key took minutes); nulls and large whole numbers stay exact."""
    n, schema = 20_000, "tile long, version long, seq long, ts timestamp, payload long"
    big = 2**53 + 1
    for k in range(2):
        rows = state.range(n).select(
            F.when(F.col("id") > 0, F.col("id") + big).alias("tile"), F.when(F.col("id") % 7 > 0, (F.col("id") * 3 + k) % 5).alias("version"), (F.col("id") + k).alias("seq"),
            F.lit(T0).alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id") + big).alias("payload"),
        )
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.latest_versions(state.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["tile"], "version", "seq", "ts")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    got = sorted((r.tile or 0, -1 if r.version is None else r.version, r.seq, r.payload) for r in state.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    want = []
    for i in range(n):
        best = None
        for k in range(2):
            v = (i * 3 + k) % 5 if i % 7 else -1
            if best is None or v > best:
                best = v
                want.append((i + big if i else 0, v, i + k, i + big if i % 3 else None))
    assert got == sorted(want)
