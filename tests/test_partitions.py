"""What is read and moved: bucketed tables, folders chosen by a join, peaks without a window."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from gridlark.functions import grid as G
from gridlark.operators import spatial as P
from gridlark.operators import tables as T
from gridlark.sources import store


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_joins_without_exchange(spark):
    name = f"dim_{uuid.uuid4().hex[:8]}"
    tiles = spark.createDataFrame([(9, 4), (9, 4), (10, 5)], "h int, v int")
    box = [[{"x": -130.0, "y": 25.0}, {"x": -65.0, "y": 25.0}, {"x": -65.0, "y": 49.0}, {"x": -130.0, "y": 49.0}]]
    shapes = spark.createDataFrame([(box,)], "rings array<array<struct<x:double,y:double>>>")
    n = 24
    dimension = store.write_bucketed(P.cell_dimension(tiles, shapes, G.TARGET, n), name, ["h", "v", "pixel"], 4)
    want = set()
    for h, v in ((9, 4), (10, 5)):
        rows = spark.range(n * n).select(F.col("id").alias("p"), *[c.alias(a) for c, a in zip(G.sinusoidal_centres(F.lit(h), F.lit(v), F.floor(F.col("id") / n), F.col("id") % n, n), ("lon", "lat"))])
        for r in rows.where("lon > -130 and lon < -65 and lat > 25 and lat < 49").select("p", G.TARGET.cell(*G.Albers().forward(F.col("lon"), F.col("lat"))).alias("cell")).where("cell is not null").collect():
            want.add((h, v, r.p, r.cell))
    assert {tuple(r) for r in dimension.select("h", "v", "pixel", "cell").collect()} == want and len(want) > 200
    facts = spark.range(5000).select((9 + F.col("id") % 2).cast("int").alias("h"), (4 + F.col("id") % 2).cast("int").alias("v"), (F.col("id") * 7 % (n * n)).cast("int").alias("pixel"), F.col("id").alias("a"))
    facts = store.write_bucketed(facts, f"fact_{name}", ["h", "v", "pixel"], 4)
    joined = facts.hint("merge").join(dimension, ["h", "v", "pixel"])
    assert "Exchange" not in plan_of(joined) and joined.count() > 1000
    for t in (name, f"fact_{name}"):
        spark.sql(f"DROP TABLE {t}")


def test_dimension_leaves_out_centres_on_the_border(spark):
    tiles = spark.createDataFrame([(8, 4), (11, 4)], "h int, v int")
    box = [[{"x": -124.0, "y": 41.75}, {"x": -85.0, "y": 41.75}, {"x": -85.0, "y": 43.25}, {"x": -124.0, "y": 43.25}]]
    shapes = spark.createDataFrame([(box,)], "rings array<array<struct<x:double,y:double>>>")
    found = P.cell_dimension(tiles, shapes, G.TARGET, 20)
    assert sorted(r[0] for r in found.select(F.floor(F.col("pixel") / 20)).distinct().collect()) == [14, 15]  # 42.75 and 42.25; rows 13 and 16 lie on the border


def test_folders_chosen_by_a_join(spark, tmp_path):
    o = spark.range(2000).select((F.col("id") % 40).cast("int").alias("tile"), F.col("id").alias("a"))
    facts = store.write_by(o, str(tmp_path / "facts"), "tile")
    spark.range(40).select(F.col("id").cast("int").alias("tile"), (F.col("id") * 3 % 40).alias("land")).write.parquet(str(tmp_path / "tiles"))
    few = spark.read.parquet(str(tmp_path / "tiles")).where("land < 5").select("tile")
    df = facts.join(F.broadcast(few), "tile")
    plan = plan_of(df)
    assert "dynamicpruning" in plan
    assert df.count() == 5 * 50
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    text = plan_of(df)
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", text), scans


def greedy(rows, keep, apart):
    out = []
    for v, d in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(out) < keep and all(abs((d - e).days) >= apart for _, e in out):
            out.append((v, d))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_peaks_by_passes(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(30) if rng.random() < 0.9 else None, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(1500))) for _ in range(300)]
    df = spark.createDataFrame(rows, "v int, day date")
    got = [(r.value, r.day) for r in T.greedy_peaks(df, "day", "v", 6).orderBy("rank").collect()]
    assert got == greedy([r for r in rows if r[0] is not None], 6, 183)
    assert "Window" not in plan_of(T.greedy_peaks(df, "day", "v"))


def test_peaks_of_many_rows(spark):
    n = 3_000_000
    df = spark.range(n).select(F.date_add(F.lit("1900-01-01"), (F.col("id") % 40_000).cast("int")).alias("day"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    got = T.greedy_peaks(df, "day", "v", 3).orderBy("rank").collect()
    assert len(got) == 3 and got[0]["value"] == df.agg(F.max("v")).first()[0]
    assert T.greedy_peaks(df.where("1 = 0"), "day", "v").count() == 0
