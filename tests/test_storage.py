"""Stores: idempotent partials, records, checksums, the stream of partials."""

import datetime as dt

from pyspark.sql import functions as F

from gridlark.operators import daily as D
from gridlark.sources import store
from gridlark.streaming.partials import daily_partials, latest_versions, windowed_sums


def sums(spark, day, value):
    return spark.createDataFrame([(day, 1, value, 1.0, 0.0, 0.0)], "day date, cell int, a double, b double, c double, d double")


def test_partials_replace_their_day(spark, tmp_path):
    path, a, b = str(tmp_path / "p"), dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    for day, value in ((a, 1.0), (b, 2.0), (a, 5.0)):
        store.write_partials(sums(spark, day, value), path)
    assert D.accumulate(store.read_partials(spark, path), ["cell"]).first().a == 7


def test_records(spark, tmp_path):
    for name, text in (("b", '{"month": "2001-02", "days": 28, "more": 1}'), ("a", '{"month": "2001-01"}'), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    got = store.read_records(spark, str(tmp_path)).collect()
    assert [(r.month, r.days) for r in got] == [("2001-01", None), ("2001-02", 28)] and len(got[0]) == 13


def test_features(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"start": "2020001 1200", "density": " heavy", "rings": [[{"x": 0, "y": 0}]]}\n{"density": "x"}\n{oops\n')
    features, rejects = store.read_features(spark, str(tmp_path))
    assert features.count() == 1 and {r.state: r.n for r in rejects.collect()} == {"kept": 1, "no geometry": 1, "unreadable": 1}


def test_checksums(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"")
    found = store.checksums(spark, str(tmp_path))
    listed = spark.createDataFrame([("x.bin", found.first().sha256), ("y.bin", "0"), ("z.bin", "0")], "name string, sha256 string")
    assert {r.name: r.state for r in store.verified(found, listed).collect()} == {"x.bin": "ok", "y.bin": "missing", "z.bin": "missing"}


def test_cube_and_csv(spark, tmp_path):
    cube = spark.createDataFrame([(2020, 1, 0.1), (2021, 1, 0.2)], "year int, cell int, a double")
    store.write_cube(cube, str(tmp_path / "c"), values=["a"])
    back = store.read_cubes(spark, [str(tmp_path / "c")])
    assert dict(back.dtypes)["a"] == "float" and back.where("year = 2021").count() == 1
    store.write_csv(cube, str(tmp_path / "t"), ["year"])
    assert store.read_csv(spark, str(tmp_path / "t"), "year int, cell int, a double").count() == 2
    assert store.summary_json(cube.withColumn("z", F.lit(None).cast("int")), "year").first().value == '{"year":2020,"cell":1,"a":0.1,"z":null}'


def test_stream_of_partials(spark, tmp_path):
    schema = "day date, cell int, a double, b double, c double, d double"
    for k in range(3):
        sums(spark, dt.date(2020, 1, 1 + k), float(k + 1)).write.mode("append").parquet(str(tmp_path / "in"))
    q = daily_partials(spark, str(tmp_path / "in"), schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert D.accumulate(store.read_partials(spark, str(tmp_path / "out")), ["cell"]).first().a == 6


def test_stream_state(spark, tmp_path):
    rows = [("a", 1, 1, 2.0), ("a", 3, 2, 4.0), ("a", 3, 3, 8.0), ("b", 2, 4, 1.0)]
    df = spark.createDataFrame(rows, "k string, version int, seq int, v double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 40000))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    found = {"latest": latest_versions(stream, ["k"], "version", "seq").select("k", "version", "seq"), "sums": windowed_sums(stream, "ts", "v", "k").select("k", "w.start", "total", "n")}
    for name, result in found.items():
        result.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", 3, 2), ("b", 2, 4)]
    assert sorted((r.k, r.total, r.n) for r in spark.table("sums").collect()) == [("a", 6.0, 2), ("a", 8.0, 1), ("b", 1.0, 1)]
