"""Exact clips, unions and dissolved borders of polygons: rings ARRAY<ARRAY<STRUCT<x, y>>>, even-odd.

`clipped` overlays one pair of shapes a time, `union_area` one latitude strip of a key at a time, `repaired` one shape at a time,
each in an Arrow kernel; `dissolved` joins neighbours that share whole edges with DataFrame steps alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import overlay as O
from gridlark.session import scratch

RINGS = "array<array<struct<x:double,y:double>>>"


def mapped(rings: str, to) -> Column:
    """Rings with each point (x, y) put through a function of columns, such as Albers().forward."""

    def point(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))


def _plain(found: list) -> pa.Array:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return pa.array([[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in found], type=kind)


def repaired(shapes: DataFrame, rings: str = "rings") -> DataFrame:
    """Shapes with rings that neither cross nor touch themselves along an edge, covering what the old ones cover; those that cover nothing go.

    Nulls, points that aren't finite and rings without area are left out; a shape that is valid keeps its border.
    """

    @F.arrow_udf(RINGS)
    def kernel(column: pa.Array) -> pa.Array:
        return _plain([O.rings(O.edges_of(r)) for r in column.to_pylist()])

    return shapes.withColumn(rings, kernel(rings)).where(F.size(rings) > 0)


def ring_area(rings: str) -> Column:
    """Area of rings as overlays give them: holes run the other way round, so signed areas add up."""
    return F.expr(
        f"aggregate(transform({rings}, r -> aggregate(transform(r, (p, i) -> p.x * get(r, (i + 1) % size(r)).y - get(r, (i + 1) % size(r)).x * p.y), 0D, (a, v) -> a + v)), 0D, (a, v) -> a + v) / 2"
    )


def _boxes(shapes: DataFrame, rings: str, name: str) -> DataFrame:
    low = lambda of, c: F.expr(f"array_{of}(flatten(transform({rings}, r -> transform(r, p -> p.{c}))))")
    box = F.struct(low("min", "x").alias("x0"), low("max", "x").alias("x1"), low("min", "y").alias("y0"), low("max", "y").alias("y1"))
    return shapes.withColumn(name, box).where(f"{name}.x0 is not null")


def clipped(shapes: DataFrame, domain: DataFrame, bin_size: float, rings: str = "rings", domain_rings: str = "domain_rings") -> DataFrame:
    """Each pair of a shape and a domain shape that share area: the columns of both (but domain_rings), the shared part's rings and its area.

    Boxes are listed under the bins that they cover; a pair that meets in several bins is kept in the first one only.
    """

    def binned(df: DataFrame, of: str, box: str) -> DataFrame:
        span = lambda c: F.sequence(F.floor(F.col(f"{box}.{c}0") / bin_size), F.floor(F.col(f"{box}.{c}1") / bin_size))
        return _boxes(df, of, box).withColumn("_by", F.explode(span("y"))).withColumn("_bx", F.explode(span("x")))

    pairs = binned(shapes, rings, "_a").join(binned(domain, domain_rings, "_b"), ["_bx", "_by"])
    for c in "xy":
        pairs = pairs.where(f"_a.{c}0 <= _b.{c}1 and _b.{c}0 <= _a.{c}1 and _b{c} = floor(greatest(_a.{c}0, _b.{c}0) / {bin_size!r}D)")

    @F.arrow_udf(RINGS)
    def kernel(a: pa.Array, b: pa.Array) -> pa.Array:
        return _plain([O.rings(np.concatenate([O.edges_of(p), O.edges_of(q, 1, 1)]), O.intersection) for p, q in zip(a.to_pylist(), b.to_pylist())])

    out = pairs.withColumn(rings, kernel(rings, domain_rings)).where(F.size(rings) > 0).withColumn("area", ring_area(rings))
    return out.drop("_a", "_b", "_bx", "_by", domain_rings)


def strip_edges(shapes: DataFrame, by: Sequence[str], shape: str, height: float, rings: str = "rings") -> DataFrame:
    """(by, strip, polygon, x0, y0, x1, y1): the edges of all rings, cut at multiples of the height; horizontal ones are left out.

    Both pieces of a cut edge end at the same point, so strips fit together.
    """
    step = f"transform({rings}, r -> transform(r, (p, i) -> named_struct('a', if(p.y <= get(r, (i + 1) % size(r)).y, p, get(r, (i + 1) % size(r))), 'b', if(p.y <= get(r, (i + 1) % size(r)).y, get(r, (i + 1) % size(r)), p))))"
    edges = shapes.select(*by, F.xxhash64(shape).alias("polygon"), F.explode(F.expr(f"flatten({step})")).alias("e")).where("e.a.y < e.b.y and e.a.x is not null and e.b.x is not null")
    h = F.lit(float(height))
    cut = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.col("e.a.y") / h), F.ceil(F.col("e.b.y") / h) - 1)))
    low, high = F.greatest(F.col("e.a.y"), F.col("strip") * h), F.least(F.col("e.b.y"), (F.col("strip") + 1) * h)
    at = lambda y: F.col("e.a.x") + (F.col("e.b.x") - F.col("e.a.x")) * ((y - F.col("e.a.y")) / (F.col("e.b.y") - F.col("e.a.y")))
    x0, x1 = F.when(low == F.col("e.a.y"), F.col("e.a.x")).otherwise(at(low)), F.when(high == F.col("e.b.y"), F.col("e.b.x")).otherwise(at(high))
    return cut.select(*by, "strip", "polygon", x0.alias("x0"), low.alias("y0"), x1.alias("x1"), high.alias("y1"))


def union_area(shapes: DataFrame, by: Sequence[str], shape: str, height: float, domain: DataFrame | None = None, domain_rings: str = "domain_rings") -> DataFrame:
    """(by, area): what the shapes of a key cover together, each place once; with a domain, only inside it.

    A strip of a key is one task's work, so a key with many shapes needs no large task: halve the height for more of them. The
    domain's edges are cut once and follow each strip that has shapes.
    """
    by = list(by)
    edges = strip_edges(shapes, by, shape, height).withColumn("side", F.lit(0))
    wanted = O.union
    if domain is not None:
        around = strip_edges(domain.withColumn("_one", F.lit(0)), [], "_one", height, domain_rings)
        edges = edges.unionByName(edges.select(*by, "strip").distinct().join(around, "strip").withColumn("side", F.lit(1)))
        wanted = O.intersection

    def kernel(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        e = part[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        polygon = part["polygon"].factorize()[0] * 2 + part["side"].to_numpy()
        found = O.area(np.concatenate([e, polygon[:, None], part["side"].to_numpy(dtype=float)[:, None]], axis=1), wanted)
        return pd.DataFrame([[*key[: len(by)], found]], columns=[*by, "area"])

    kinds = ", ".join(f"`{c}` {shapes.schema[c].dataType.simpleString()}" for c in by)
    parts = edges.groupBy(*by, "strip").applyInPandas(kernel, f"{kinds}, area double")
    return parts.groupBy(*by).agg(F.sum("area").alias("area"))


def class_areas(shapes: DataFrame, day: str, kind: str, kinds: Sequence[str], shape: str, height: float, domain: DataFrame | None = None) -> DataFrame:
    """(day, class, area, shapes) of each day that has shapes: for all of them and for each kind by itself, zero where the day has none of it."""
    each = shapes.withColumn("class", F.explode(F.when(F.col(kind).isin(*kinds), F.array(F.lit("all"), F.col(kind))).otherwise(F.array(F.lit("all")))))
    spine = shapes.select(day).distinct().withColumn("class", F.explode(F.array(F.lit("all"), *map(F.lit, kinds))))
    counts = each.groupBy(day, "class").agg(F.count("*").alias("shapes"))
    areas = union_area(each, [day, "class"], shape, height, domain)
    return spine.join(areas, [day, "class"], "left").join(counts, [day, "class"], "left").fillna({"area": 0.0, "shapes": 0})


# ---- neighbours that share whole edges ----------------------------------------------------------------------------------


def half_edges(shapes: DataFrame, by: Sequence[str], rings: str = "rings") -> DataFrame:
    """(by, a, b): all edges with the shape to their left, for shapes whose first ring is the outer one and the others holes."""
    ring = shapes.select(*by, F.posexplode(F.filter(rings, lambda r: F.size(r) > 2)).alias("_k", "_r"))
    turn = F.expr("aggregate(transform(_r, (p, i) -> p.x * get(_r, (i + 1) % size(_r)).y - get(_r, (i + 1) % size(_r)).x * p.y), 0D, (a, v) -> a + v)")
    ring = ring.withColumn("_r", F.when((turn > 0) == (F.col("_k") == 0), F.col("_r")).otherwise(F.reverse("_r")))
    return ring.select(*by, F.explode(F.expr("transform(_r, (p, i) -> named_struct('a', p, 'b', get(_r, (i + 1) % size(_r))))")).alias("_e")).select(*by, "_e.*").where("a <> b")


def border(shapes: DataFrame, by: Sequence[str], rings: str = "rings") -> DataFrame:
    """(by, a, b): the half-edges that no neighbour runs along the other way. Sums are merged where shapes are read."""
    edges = half_edges(shapes, by, rings).select(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(F.col("a") < F.col("b"), 1).otherwise(-1).alias("way"))
    net = edges.groupBy(*by, "lo", "hi").agg(F.sum("way").alias("net")).where("net <> 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.abs("net").cast("int"))))
    return net.select(*by, F.when(F.col("net") > 0, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("net") > 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dissolved(shapes: DataFrame, by: Sequence[str], rings: str = "rings") -> DataFrame:
    """(by, ring, points, area) of each ring around a key's shapes taken together; holes have a negative area.

    Half-edges find their successor by a join on the point between them (where several leave it, the one that turns most to the
    left, so that parts that only touch stay apart). Rings are named by pointer jumping: each half-edge looks twice as far ahead
    every round, so a ring of n edges takes about log2(n) rounds for its name and as many for the order of its points.
    """
    by = list(by)
    edges = _stored(border(shapes, by, rings).withColumn("id", F.monotonically_increasing_id()))
    nxt = edges.select(*by, F.col("a").alias("b"), F.col("b").alias("c"), F.col("id").alias("next"))
    u, v = ("b.x - a.x", "b.y - a.y"), ("c.x - b.x", "c.y - b.y")
    turn = F.expr(f"atan2(({u[0]}) * ({v[1]}) - ({u[1]}) * ({v[0]}), ({u[0]}) * ({v[0]}) + ({u[1]}) * ({v[1]}))")
    follow = edges.join(nxt, [*by, "b"]).groupBy("id").agg(F.max_by("next", F.struct(turn.alias("t"), F.col("next"))).alias("next"))
    links = _stored(follow)

    state, total = links.withColumn("ring", F.col("id")), None
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"))
        state = _stored(state.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring")))
        now = state.agg(F.sum(F.col("ring").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    named = state.select("id", "ring")

    # The rank of a half-edge is its distance from the end of the ring's list, which is cut before the edge that names it.
    ranked = links.join(named, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"))
    ranked = _stored(ranked.withColumn("rank", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    while not ranked.where("next is not null").isEmpty():
        ahead = ranked.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("rank").alias("_rank"))
        ranked = _stored(ranked.join(ahead, "next", "left").select("id", "ring", F.col("_next").alias("next"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank")))
    return _collected(edges, ranked, by)


def _collected(edges: DataFrame, ranked: DataFrame, by: list[str]) -> DataFrame:
    points = edges.join(ranked, "id").groupBy(*by, "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("k"), F.col("a").alias("p")))).alias("_p"))
    out = points.select(*by, "ring", F.col("_p.p").alias("points"))
    return out.withColumn("area", ring_area("array(points)"))


def expected(df: DataFrame, count: Column | int) -> DataFrame:
    """df, or an error where it hasn't exactly so many rows; counted in the same plan."""
    n = F.lit(count) if isinstance(count, int) else count
    check = df.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") == n, F.concat(F.lit("unexpected number of rows: "), F.col("_n").cast("string"))).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).where("_ok is null").drop("_ok")  # one row
