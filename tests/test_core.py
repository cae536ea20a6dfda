"""Known answers of the observation path."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlark.functions import columns as C
from gridlark.functions import grid as G
from gridlark.operators import daily as D
from gridlark.operators import tables as T


def word(surface=0, quality=0, model=0):
    return surface << 3 | quality << 8 | model << 13


def obs(spark, rows, quality=C.BEST):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), *r) for r in rows], "pixel int, day date, raw int, word int")
    valid, flagged = C.masks(F.col("raw"), F.col("word"), quality)
    return df.select("*", (F.col("raw") * C.SCALE).alias("obs"), valid.alias("valid"), flagged.alias("flagged"))


def test_bit_fields(spark):
    row = spark.range(1).select(*[C.bits(F.lit(word(2, 11, 2)), f) for f in (C.SURFACE, C.QUALITY, C.MODEL)]).first()
    assert tuple(row) == (2, 11, 2)


@pytest.mark.parametrize(
    "raw, w, quality, valid, flagged",
    [
        (150, word(model=1), C.BEST, True, True), (150, 0, C.BEST, True, False), (150, word(surface=1), C.BEST, False, False), (-28672, 0, C.BEST, False, False),
        (150, word(quality=11), C.BEST, False, False), (150, word(quality=11), C.PERMISSIVE, True, False), (150, word(model=2), C.BEST, True, False),
    ],
)
def test_masks(spark, raw, w, quality, valid, flagged):
    r = obs(spark, [(raw, w)], quality).first()
    assert (r.valid, r.flagged) == (valid, flagged)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(100, word(model=1)), (200, 0), (-28672, 0)], (0.15, 1, 0.1, 1)), ([(-28672, 0), (-28672, 0)], (0, 0, 0, 0)), ([(300, 0)], (0.3, 1, 0, 0)),
    ],
)
def test_collapse(spark, rows, want):
    r = D.collapse(obs(spark, rows), ["pixel", "day"], "obs", "valid", "flagged").first()
    assert (r.a, r.b, r.c, r.d) == pytest.approx(want)


def test_accumulate_and_ratios(spark):
    px = spark.createDataFrame([(1, 0.2, 1.0), (2, 0.5, 1.0), (3, 0.4, 1.0), (4, 9.9, 1.0)], "pixel int, a double, b double").select("*", F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    lookup = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "pixel int, cell int")
    got = {r.cell: r for r in D.accumulate(D.located(px, lookup, ["pixel"]), ["cell"]).collect()}
    assert got[0].a == pytest.approx(0.6) and got[1].a == pytest.approx(0.5) and got[0].b == 2 and len(got) == 2
    sums = spark.createDataFrame([(0, 2.0, 10.0, 1.2, 4.0), (1, 0.0, 0.0, 0.0, 0.0), (2, 2.0, 10.0, 0.0, 0.0)], "cell int, a double, b double, c double, d double")
    r = {x.cell: x for x in D.ratios(sums, ["cell"]).collect()}
    assert tuple(r[0])[1:] == pytest.approx((0.2, 0.3, 0.12, 0.4, 10, 4))
    assert tuple(r[1])[1:] == (None, None, None, None, 0, 0)
    assert r[2].flag_index == 0 and r[2].flag_fraction == 0 and r[2].mean_flagged is None
    pooled = spark.createDataFrame([(3.0, 30.0, 0.0, 0.0), (0.9, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert T.series_ratios(pooled, []).first().mean_value == pytest.approx(3.9 / 31)


def test_names(spark):
    names = ["MCD19A2.A2022032.h13v12.061.2024226235541.hdf", "https://x/y/MCD19A2.A2020060.h01v02.061.2022100000000.hdf"]
    got = spark.createDataFrame([(n,) for n in names], "name string").select(C.parsed_name("name").alias("p")).select("p.*").collect()
    assert got[0].asDict() == {"year": 2022, "doy": 32, "h": 13, "v": 12, "collection": "061", "production": 2024226235541, "tile": "h13v12", "day": dt.date(2022, 2, 1)}
    assert got[1].day == dt.date(2020, 2, 29)
    with pytest.raises(PySparkException):
        spark.createDataFrame([("other.hdf",)], "name string").select(C.parsed_name("name")).collect()


def test_latest_version(spark):
    rows = [(0, "b", 5), (1, "a", 2022100000000), (2, "a", 2024226235541), (3, "a", 2024226235541)]
    got = T.latest(spark.createDataFrame(rows, "seq long, k string, v long"), ["k"], "v", "seq").orderBy("place").collect()
    assert [(r.k, r.seq, r.place) for r in got] == [("b", 0, 0), ("a", 2, 1)]


def test_calendar(spark):
    got = C.months(spark, "2022-11", "2023-02").collect()
    assert [r.label for r in got] == ["2022-11", "2022-12", "2023-01", "2023-02"] and got[-1].last_day == dt.date(2023, 2, 28)
    assert C.months(spark, "2000-02", "2025-07").count() == 306
    r = spark.range(1).select(C.stamp(F.lit("2020366 2359")).alias("a"), C.stamp(F.lit("junk")).alias("b"), C.days_in_month(F.lit(2024), F.lit(2)).alias("c")).first()
    assert r.a == dt.datetime(2020, 12, 31, 23, 59) and r.b is None and r.c == 29


def test_grid_and_albers(spark):
    assert (G.TARGET.nx, G.TARGET.ny, G.TARGET.nx * G.TARGET.ny) == (242, 130, 31460)
    cells = G.TARGET.cells(spark)
    first = cells.orderBy("cell").first()
    assert (first.x, first.y) == (-3_000_000 + 12_500, 3_350_000 - 12_500)
    clarke = G.Albers(a=6378206.4, e2=0.00676866)
    r = spark.range(1).select(*clarke.forward(F.lit(-75.0), F.lit(35.0))).first()
    assert tuple(r) == pytest.approx((1885472.7, 1535925.0), abs=0.1)
    back = spark.range(1).select(*clarke.inverse(F.lit(r[0]), F.lit(r[1]))).first()
    assert tuple(back) == pytest.approx((-75, 35), abs=1e-6)
    lon, lat = G.sinusoidal_centres(F.lit(9), F.lit(4), F.lit(600), F.lit(600))
    lo, la = spark.range(1).select(lon, lat).first()
    assert -125 < lo < -100 and 35 < la < 50
    assert cells.where(G.TARGET.cell(F.col("x"), F.col("y")) == F.col("cell")).count() == 31460


def test_spines_and_undefined(spark):
    d = spark.createDataFrame([(dt.date(2010, 1, 2), 5.0, 1.0), (dt.date(2011, 1, 2), 6.0, None)], "day date, total double, v double")
    got = {r.day: r for r in T.filled_days(d, "day", ["total"], {"v": 2011}, "2010-01-01", "2011-01-03").collect()}
    assert got[dt.date(2010, 1, 1)].total == 0 and got[dt.date(2010, 1, 1)].v is None and got[dt.date(2010, 1, 2)].v == 1
    assert got[dt.date(2011, 1, 2)].v == 0 and got[dt.date(2011, 1, 3)].v == 0
    c = spark.createDataFrame([(0, 2000, 1.0), (0, 2001, 1.0), (1, 2000, 1.0), (1, 2001, 0.0)], "cell int, year int, b double")
    assert [r.cell for r in T.domain(c, 2000, 2001).collect()] == [0]


def test_peaks_and_rules(spark):
    days = [(dt.date(2020, 1, 1), 5.0), (dt.date(2020, 3, 1), 9.0), (dt.date(2020, 9, 1), 4.0), (dt.date(2021, 6, 1), 9.0)]
    got = T.greedy_peaks(spark.createDataFrame(days, "day date, v double"), "day", "v").orderBy("rank").collect()
    assert [r.day for r in got] == [dt.date(2020, 3, 1), dt.date(2021, 6, 1), dt.date(2020, 9, 1)]
    broken = D.violations(spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double"), {"negative": F.col("v") < 0, "huge": F.col("v") > 9}).collect()
    assert [(r.rule, r.n) for r in broken] == [("negative", 1)]
    assert [r.rule for r in D.violations(spark.createDataFrame([], "v double"), {"negative": F.col("v") < 0}).collect()] == ["empty"]
