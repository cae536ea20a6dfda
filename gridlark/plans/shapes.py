"""Exact polygon plans: clips, dissolved areas by day and class, repaired shapes, a domain dissolved out of administrative ones, archives, and stored tables that joins read without moving them."""

from __future__ import annotations

import base64
import uuid

import pandas as pd
from pyspark.sql import functions as F

from gridlark.functions import grid as G
from gridlark.operators import overlays as V
from gridlark.operators import spatial as S
from gridlark.operators import tables as T
from gridlark.plans.inputs import rounded, table
from gridlark.plans.statistics import ALBERS, _boxes
from gridlark.session import scratch
from gridlark.sources import shapefile, store


def _ring(*points):
    return F.array(*[F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), y.cast("double").alias("y") if hasattr(y, "cast") else F.lit(y).cast("double").alias("y")) for x, y in points])


def _domain(spark, sf_dir):
    """A box by region, each with a hole."""
    x = F.lit(-124.0) + F.col("r_regionkey") * 21
    box = lambda x0, y0, x1, y1: _ring((x0, F.lit(y0)), (x1, F.lit(y0)), (x1, F.lit(y1)), (x0, F.lit(y1)))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("part"), F.array(box(x, 26.5, x + 17, 43.25), box(x + 5, 30.0, x + 9, 36.5)).alias("domain_rings"))


def _kinds(spark, sf_dir):
    """The suppliers' boxes with a day and a class each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shape"), F.col("s_nationkey").alias("day"), F.element_at(F.array(F.lit("light"), F.lit("medium"), F.lit("heavy"), F.lit("none")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("kind"))
    wrapped = F.expr("transform(rings, r -> transform(r, p -> named_struct('x', p.x - floor(r[0].x / 60 + 2) * 60, 'y', p.y)))")  # over one another, whatever their number
    return _boxes(spark, sf_dir).join(s, "shape").withColumn("rings", wrapped)


def clipped_shapes(spark, sf_dir):
    """The part of each box inside each domain shape, but for the hole."""
    got = V.clipped(_kinds(spark, sf_dir).select("shape", "rings"), _domain(spark, sf_dir), 5.0)
    return rounded(got.select("shape", "part", "area"), "area")


def class_areas(spark, sf_dir):
    """Area by day and class inside the domain, shapes over one another counted once, zero for the classes a day has none of."""
    got = V.class_areas(_kinds(spark, sf_dir), "day", "kind", ["light", "medium", "heavy"], "shape", 2.5, _domain(spark, sf_dir))
    return rounded(got.withColumnRenamed("shapes", "n"), "area")


_LAYOUT = {"day": "int", "all_km2": "double", "light_km2": "double", "medium_km2": "double", "heavy_km2": "double", "n_heavy_polys": "long", "heavy_max_poly_km2": "double"}


def daily_layout(spark, sf_dir):
    """The areas as the daily table: columns by class under their own names, in a fixed order, null where nothing was measured."""
    wide = T.class_columns(class_areas(spark, sf_dir), ["day"], "class", ["all", "light", "heavy"], {"area": "{}_km2", "n": "n_{}_polys"})
    return T.fixed_columns(wide, _LAYOUT)


def repaired_shapes(spark, sf_dir):
    """Bow ties: rings that cross themselves come back as two triangles; of every third nothing is left."""
    s = table(spark, sf_dir, "supplier")
    w, h = 1.0 + F.col("s_suppkey") % 5, F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(0.5 + F.col("s_suppkey") % 4)
    bows = s.select(F.col("s_suppkey").alias("shape"), F.array(_ring((F.lit(0.0), F.lit(0.0)), (w, h), (w, F.lit(0.0)), (F.lit(0.0), h))).alias("rings"))
    return rounded(V.repaired(bows).select("shape", F.size("rings").alias("n"), V.ring_area("rings").alias("area")), "area")


#: Nations whose suppliers' squares the domain leaves out.
_LEFT_OUT = (0, 3, 7)
_WIDE = 16


def dissolved_domain(spark, sf_dir):
    """Unit squares of all suppliers but those of some nations, as many as the nations' own numbers say, dissolved by region: its border."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    x, y = F.col("s_suppkey") % _WIDE, F.floor(F.col("s_suppkey") / _WIDE)
    squares = s.where(~F.col("s_nationkey").isin(*_LEFT_OUT)).select(F.col("n_regionkey").alias("region"), F.array(_ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))).alias("rings"))
    kept = table(spark, sf_dir, "supplier").agg(F.count("*") - F.count(F.when(F.col("s_nationkey").isin(*_LEFT_OUT), 1))).first()[0]
    rings = V.dissolved(V.expected(squares, kept), ["region"])
    return rounded(rings.groupBy("region").agg(F.sum("area").alias("area"), F.sum(F.size("points")).alias("edges")), "area")


def shapefile_records(spark, sf_dir):
    """Archives of 64 suppliers' boxes each, written to disk and scanned as files: each record with its state, day and area.

    Text is the only sink of Spark whose files are a row's own bytes, so the archives stand in base64.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shape"), F.col("s_nationkey"))
    day = F.when(F.col("shape") % 13 == 0, "2021001").when(F.col("shape") % 7 == 0, "someday").otherwise(F.concat(F.lit("2020"), F.lpad((F.col("shape") % 366 + 1).cast("string"), 3, "0")))
    kind = F.element_at(F.array(F.lit(" light"), F.lit("HEAVY"), F.lit("Medium")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    flat = _boxes(spark, sf_dir).join(s, "shape").select("shape", (F.col("shape") / 64).cast("int").alias("archive"), F.expr("flatten(transform(rings[0], p -> array(p.x, p.y)))").alias("xy"), day.alias("start"), kind.alias("kind"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in part.sort_values("shape").itertuples():
            ring = [(r.xy[k], r.xy[k + 1]) for k in range(0, len(r.xy), 2)]
            rows.append((None if r.shape % 11 == 0 else [ring], {"Id": str(r.shape), "Start": f"{r.start} 1546", "Density": r.kind}))
        return pd.DataFrame({"archive": part["archive"].iloc[:1], "value": [base64.b64encode(shapefile.packed(rows)).decode()]})

    path = scratch(spark)
    flat.groupBy("archive").applyInPandas(pack, "archive int, value string").write.partitionBy("archive").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    found = shapefile.dated(shapefile.features(files.select("path", F.unbase64(F.decode("content", "UTF-8")).alias("content")), 20), 2020)
    area = F.when(F.col("state") == "kept", V.ring_area("rings"))
    out = found.select(F.col("attributes")["Id"].cast("long").alias("shape"), "state", F.when(F.col("state") == "kept", F.col("day").cast("string")).alias("day"), "density", F.abs(area).alias("area"))
    return rounded(out, "area")


_PIXELS = 20  # along a tile's side


def pixel_cells(spark, sf_dir):
    """Quantities by cell, over a stored dimension of pixels inside the domain; both sides are bucketed, so the join moves nothing."""
    c = table(spark, sf_dir, "customer").select((8 + F.col("c_nationkey") % 6).alias("h"), (4 + F.col("c_nationkey") % 3).alias("v"))
    domain = _domain(spark, sf_dir).select(F.slice("domain_rings", 1, 1).alias("rings"))
    name, keys = f"pixels_{uuid.uuid4().hex}", ["h", "v", "pixel"]
    dimension = store.write_bucketed(S.cell_dimension(c, domain, G.TARGET, _PIXELS), name, keys, 8)
    li = table(spark, sf_dir, "lineitem")
    t = (F.col("l_suppkey") % 6).cast("int")
    facts = li.select((8 + t).alias("h"), (4 + t % 3).alias("v"), (F.col("l_partkey") % _PIXELS**2).cast("int").alias("pixel"), F.col("l_quantity").alias("q"))
    facts = store.write_bucketed(facts, f"facts_{name}", keys, 8)
    return rounded(facts.join(dimension, keys).groupBy("cell").agg(F.count("*").alias("n"), F.sum("q").alias("q")), "q")


def pruned_partitions(spark, sf_dir):
    """Orders stored by tile; a join with the useful tiles decides which folders are read."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("int").alias("tile"), "o_totalprice")
    stored = store.write_by(o, scratch(spark), "tile")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select((F.col("c_custkey") % 50).cast("int").alias("tile")).distinct()
    return rounded(stored.join(F.broadcast(c), "tile").groupBy("tile").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n")), "total")  # 50 tiles at most


QUERIES = {f.__name__: f for f in (clipped_shapes, class_areas, daily_layout, repaired_shapes, dissolved_domain, shapefile_records, pixel_cells, pruned_partitions)}

_DOMAIN = """d AS (SELECT r_regionkey AS part, -124 + r_regionkey * 21 AS px FROM region),
dp AS (SELECT part, px AS dx0, px + 17 AS dx1, CAST(26.5 AS DOUBLE) AS dy0, CAST(43.25 AS DOUBLE) AS dy1, 1 AS sign FROM d UNION ALL SELECT part, px + 5, px + 9, 30, 36.5, -1 FROM d),
b0 AS (SELECT s_suppkey AS shape, s_nationkey AS day, ['light', 'medium', 'heavy', 'none'][s_suppkey % 4 + 1] AS kind, CAST(-124.0 AS DOUBLE) + s_suppkey * CAST(1.37 AS DOUBLE) AS x,
  25 + s_suppkey * 7 % 20 AS y0, 1 + s_suppkey % 5 AS w, CAST(0.5 AS DOUBLE) + s_suppkey % 3 AS h FROM supplier),
b AS (SELECT shape, day, kind, x - floor(x / 60 + 2) * 60 AS x0, x - floor(x / 60 + 2) * 60 + w AS x1, y0, y0 + h AS y1 FROM b0)"""

ORACLES = {
    "clipped_shapes": f"""WITH {_DOMAIN}, p AS (SELECT shape, part, sign * greatest(0, least(x1, dx1) - greatest(x0, dx0)) * greatest(0, least(y1, dy1) - greatest(y0, dy0)) AS a FROM b, dp)
SELECT shape, part, round(sum(a), 6) AS area FROM p GROUP BY ALL HAVING sum(a) > 1e-12""",
    "class_areas": f"""WITH {_DOMAIN}, k AS (SELECT *, 'all' AS class FROM b UNION ALL SELECT *, kind FROM b WHERE kind <> 'none'),
xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS x2 FROM (SELECT x0 AS x FROM b UNION SELECT x1 FROM b UNION SELECT dx0 FROM dp UNION SELECT dx1 FROM dp)),
ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS y2 FROM (SELECT y0 AS y FROM b UNION SELECT y1 FROM b UNION SELECT dy0 FROM dp UNION SELECT dy1 FROM dp)),
cells AS (SELECT DISTINCT day, class, x, x2, y, y2 FROM k JOIN xs ON x >= x0 AND x2 <= x1 JOIN ys ON y >= y0 AND y2 <= y1),
held AS (SELECT day, class, x, x2, y, y2 FROM cells JOIN dp ON x >= dx0 AND x2 <= dx1 AND y >= dy0 AND y2 <= dy1 GROUP BY ALL HAVING sum(sign) > 0),
a AS (SELECT day, class, sum((x2 - x) * (y2 - y)) AS area FROM held GROUP BY ALL), n AS (SELECT day, class, count(*) AS n FROM k GROUP BY ALL),
spine AS (SELECT DISTINCT day, c.class FROM b, (VALUES ('all'), ('light'), ('medium'), ('heavy')) c(class))
SELECT day, class, round(coalesce(area, 0), 6) AS area, coalesce(n, 0) AS n FROM spine LEFT JOIN a USING (day, class) LEFT JOIN n USING (day, class)""",
    "repaired_shapes": "SELECT s_suppkey AS shape, 2 AS n, round((1 + s_suppkey % 5) * (CAST(0.5 AS DOUBLE) + s_suppkey % 4) / 2, 6) AS area FROM supplier WHERE s_suppkey % 3 <> 0",
    "pixel_cells": f"""WITH t AS (SELECT DISTINCT 8 + c_nationkey % 6 AS h, 4 + c_nationkey % 3 AS v FROM customer),
s AS (SELECT h, v, CAST(i AS INT) AS pixel, (pi() / 2 - (v + (i // {_PIXELS} + CAST(0.5 AS DOUBLE)) / {_PIXELS}) * pi() / 18) AS phi, (-pi() + (h + (i % {_PIXELS} + CAST(0.5 AS DOUBLE)) / {_PIXELS}) * pi() / 18) AS sx FROM t, range({_PIXELS**2}) r(i)),
places AS (SELECT h, v, pixel, degrees(sx / cos(phi)) AS lon, degrees(phi) AS lat FROM s), {ALBERS},
d AS (SELECT h, v, pixel, cell FROM cells WHERE cell IS NOT NULL AND lat > 26.5 AND lat < 43.25 AND EXISTS (SELECT 1 FROM region WHERE lon > -124 + r_regionkey * 21 AND lon < -107 + r_regionkey * 21)),
f AS (SELECT 8 + l_suppkey % 6 AS h, 4 + l_suppkey % 6 % 3 AS v, l_partkey % {_PIXELS**2} AS pixel, l_quantity AS q FROM lineitem)
SELECT cell, count(*) AS n, round(sum(q), 6) AS q FROM f JOIN d USING (h, v, pixel) GROUP BY cell""",
    "pruned_partitions": """SELECT CAST(o_custkey % 50 AS INT) AS tile, round(sum(o_totalprice), 6) AS total, count(*) AS n FROM orders WHERE o_custkey % 50 IN (SELECT c_custkey % 50 FROM customer WHERE c_acctbal > 9000) GROUP BY ALL""",
    "shapefile_records": """WITH b AS (SELECT s_suppkey AS shape, CASE WHEN s_suppkey % 11 = 0 THEN 'unreadable' WHEN s_suppkey % 13 = 0 THEN 'other year' WHEN s_suppkey % 7 = 0 THEN 'no date' ELSE 'kept' END AS state,
  ['Light', 'Heavy', 'Medium'][s_nationkey % 3 + 1] AS density, (1 + s_suppkey % 5) * (CAST(0.5 AS DOUBLE) + s_suppkey % 3) AS area FROM supplier)
SELECT shape, state, CASE WHEN state = 'kept' THEN CAST(CAST(DATE '2020-01-01' + CAST(shape % 366 AS INT) AS DATE) AS VARCHAR) END AS day, density, CASE WHEN state = 'kept' THEN round(area, 6) END AS area FROM b""",
    "dissolved_domain": f"""WITH q AS (SELECT n_regionkey AS region, s_suppkey % {_WIDE} AS x, s_suppkey // {_WIDE} AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey NOT IN {_LEFT_OUT}),
e AS (SELECT region, x, y, 0 AS k FROM q UNION ALL SELECT region, x, y + 1, 0 FROM q UNION ALL SELECT region, x, y, 1 FROM q UNION ALL SELECT region, x + 1, y, 1 FROM q),
o AS (SELECT region FROM e GROUP BY region, x, y, k HAVING count(*) = 1)
SELECT region, (SELECT CAST(count(*) AS DOUBLE) FROM q WHERE q.region = o.region) AS area, count(*) AS edges FROM o GROUP BY region""",
}
ORACLES["daily_layout"] = f"""SELECT CAST(day AS INT) AS day, max(area) FILTER (class = 'all') AS all_km2, max(area) FILTER (class = 'light') AS light_km2, CAST(NULL AS DOUBLE) AS medium_km2, max(area) FILTER (class = 'heavy') AS heavy_km2,
  max(n) FILTER (class = 'heavy') AS n_heavy_polys, CAST(NULL AS DOUBLE) AS heavy_max_poly_km2 FROM ({ORACLES["class_areas"]}) GROUP BY day"""
