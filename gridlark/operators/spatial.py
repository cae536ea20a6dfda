"""Points, polygons and neighbourhoods by equi-joins on grid bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import ratio
from gridlark.functions.grid import Albers, Grid, cos_weight, sinusoidal_centres


def binned_pairs(points: DataFrame, shapes: DataFrame, bin_size: float) -> DataFrame:
    """Points with the shapes whose bounding box holds them: each box is listed under the bins it covers, and points join on their own bin."""
    boxes = shapes.select(
        "*",
        F.expr("array_min(flatten(transform(rings, r -> transform(r, p -> p.x))))").alias("x0"), F.expr("array_max(flatten(transform(rings, r -> transform(r, p -> p.x))))").alias("x1"),
        F.expr("array_min(flatten(transform(rings, r -> transform(r, p -> p.y))))").alias("y0"), F.expr("array_max(flatten(transform(rings, r -> transform(r, p -> p.y))))").alias("y1"),
    )
    low = lambda c: F.floor(F.col(c) / bin_size)
    tiles = boxes.withColumn("_by", F.explode(F.sequence(low("y0"), low("y1")))).withColumn("_bx", F.explode(F.sequence(low("x0"), low("x1"))))
    near = points.withColumn("_bx", low("x")).withColumn("_by", low("y")).join(tiles, ["_bx", "_by"])
    return near.where("x between x0 and x1 and y between y0 and y1").drop("_bx", "_by", "x0", "x1", "y0", "y1")


def repaired(shapes: DataFrame) -> DataFrame:
    """Shapes without points that repeat the one before and without rings of fewer than three points; those left with none go."""
    fresh = "filter(r, (p, i) -> i = 0 or p <> get(r, i - 1))"
    kept = F.expr(f"filter(transform(rings, r -> {fresh}), r -> size(array_distinct(r)) > 2)")
    return shapes.withColumn("rings", kept).where(F.size("rings") > 0)


def inside(x: str, y: str, rings: str, edge: bool) -> Column:
    """Even-odd ray casting over all edges of the rings, without leaving the JVM; points on an edge count as inside if edge is true."""
    edges = f"flatten(transform(filter({rings}, r -> size(r) > 2), r -> transform(r, (p, i) -> named_struct('a', p, 'b', get(r, (i + 1) % size(r))))))"
    on = (
        f"exists({edges}, e -> abs((e.b.x - e.a.x) * ({y} - e.a.y) - (e.b.y - e.a.y) * ({x} - e.a.x)) <= 1e-12D"
        f" and {x} between least(e.a.x, e.b.x) and greatest(e.a.x, e.b.x) and {y} between least(e.a.y, e.b.y) and greatest(e.a.y, e.b.y))"
    )
    crossed = f"(e.a.y > {y}) <> (e.b.y > {y}) and {x} < (e.b.x - e.a.x) * ({y} - e.a.y) / nullif(e.b.y - e.a.y, 0D) + e.a.x"
    odd = f"size(filter({edges}, e -> coalesce({crossed}, false))) % 2 = 1"
    return F.expr(f"({odd}) or ({on})" if edge else f"({odd}) and not ({on})")


def point_in_polygon(points: DataFrame, shapes: DataFrame, bin_size: float = 1.0, edge: bool = True) -> DataFrame:
    """(points' columns, shapes' columns) of every hit. points: x, y; shapes: rings ARRAY<ARRAY<STRUCT<x, y>>>."""
    return binned_pairs(points, shapes, bin_size).where(inside("x", "y", "rings", edge))


def shoelace_area(ring: str) -> Column:
    """Area of a simple ring in the units of its coordinates."""
    return F.abs(F.expr(
        f"aggregate(transform({ring}, (p, i) -> p.x * get({ring}, (i + 1) % size({ring})).y - get({ring}, (i + 1) % size({ring})).x * p.y), 0D, (a, v) -> a + v)"
    )) / 2


def covered_area(hits: DataFrame, keys: Sequence[str], cell: str, cell_area: Column) -> DataFrame:
    """Area of the different covered cells by key: overlapping shapes dissolve; an approximation by cell centres."""
    return hits.select(*keys, cell, cell_area.alias("_area")).distinct().groupBy(*keys).agg(F.sum("_area").alias("area"), F.count("*").alias("cells"))


def cell_dimension(tiles: DataFrame, shapes: DataFrame, grid: Grid, pixels: int, bin_size: float = 2.0) -> DataFrame:
    """(h, v, pixel, cell) of each pixel centre of the tiles (h, v) that lies in one of the shapes (rings, in lon and lat) and on the grid.

    The whole chain: sinusoidal tile, lon and lat, ray cast without the border, Albers, cell. Store it once with store.write_bucketed.
    """
    places = tiles.select("h", "v").distinct().withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(pixels * pixels - 1))))
    lon, lat = sinusoidal_centres(F.col("h"), F.col("v"), F.floor(F.col("pixel") / pixels), F.col("pixel") % pixels, pixels)
    seen = point_in_polygon(places.withColumn("x", lon).withColumn("y", lat), shapes.select("rings"), bin_size, edge=False)
    return seen.select("h", "v", "pixel", grid.cell(*Albers().forward(F.col("x"), F.col("y"))).alias("cell")).where("cell is not null").distinct()


def remap(fine: DataFrame, grid: Grid, x: Column, y: Column, value: str, lat: Column, keys: Sequence[str], in_domain: Column) -> DataFrame:
    """Coarse cells as weighted means of the fine cells whose centre they hold; land: weighted share inside the domain."""
    w = cos_weight(lat)
    tagged = fine.withColumn("cell", grid.cell(x, y)).where("cell is not null").withColumn("_w", w).withColumn("_in", F.when(in_domain, F.col("_w")).otherwise(0.0))
    return tagged.groupBy("cell", *keys).agg(
        (F.sum(F.col(value) * F.col("_in")) / F.nullif(F.sum("_in"), F.lit(0.0))).alias("value"), ratio(F.sum("_in"), F.sum("_w")).alias("land")
    )


def smoothed(cells: DataFrame, value: str, sigma: float, reach: int, least: float = 0.35, tile: int = 256) -> DataFrame:
    """Masked Gaussian smoothing: the weighted mean of the values within reach, for the cells whose neighbours have more than the least weight.

    Cells are dealt to square tiles, those near a border to the neighbouring tiles too; each tile smooths values and mask along
    its rows and then along its columns, so the work is in proportion to the reach and a tile's task has a fixed size. A row and
    column that repeat count as the sum of their values, as many times as they are there.
    """
    steps = np.arange(-reach, reach + 1)
    one = np.exp(-(steps**2) / (2 * sigma**2))
    one = one / one.sum()
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    dealt = cells.select("row", "col", F.col(value).cast("double").alias("v")).withColumn("_ty", near("row")).withColumn("_tx", near("col"))

    def kernel(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = tile + 2 * reach
        y, x = part["row"].to_numpy() - key[0] * tile + reach, part["col"].to_numpy() - key[1] * tile + reach
        ok = part["v"].notna().to_numpy()
        sums = np.zeros((2, size, size))
        np.add.at(sums[0], (y[ok], x[ok]), part["v"].to_numpy()[ok])
        np.add.at(sums[1], (y[ok], x[ok]), 1.0)
        for axis in (1, 2):
            sums = sum(w * np.roll(sums, k, axis) for w, k in zip(one, steps))  # what rolls around stays in the halo
        own = (y >= reach) & (y < reach + tile) & (x >= reach) & (x < reach + tile)
        total, weight = sums[0, y[own], x[own]], sums[1, y[own], x[own]]
        found = pd.DataFrame({"row": part["row"].to_numpy()[own], "col": part["col"].to_numpy()[own], "smooth": total / np.where(weight > 0, weight, 1), "weight": weight})
        return found[weight > least].drop_duplicates(["row", "col"])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("row", "col"))
    return dealt.groupBy("_ty", "_tx").applyInPandas(kernel, f"{kinds}, smooth double, weight double")


def scattered(values: DataFrame, grid: DataFrame, key: str = "cell") -> DataFrame:
    """Values on the whole grid; null where there are none."""
    return grid.join(values, key, "left")


def hexbins(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Counts on square bins of two values, with their decimal logarithm."""
    counted = df.groupBy(F.floor(F.col(x) / size).alias("bx"), F.floor(F.col(y) / size).alias("by")).agg(F.count("*").alias("n"))
    return counted.withColumn("log_n", F.log10("n"))
