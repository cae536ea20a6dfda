"""Grids and projections as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from math import atanh, cos, radians, sin, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Square cells, rows from the top; cell = row * nx + column."""

    xmin: float
    ymax: float
    res: float
    nx: int
    ny: int

    def cell(self, x: Column, y: Column) -> Column:
        """Number of the cell that holds a point; null outside."""
        i, j = F.floor((x - self.xmin) / self.res), F.floor((F.lit(self.ymax) - y) / self.res)
        inside = (i >= 0) & (i < self.nx) & (j >= 0) & (j < self.ny)
        return F.when(inside, j * self.nx + i).cast("int")

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, row, col, x, y) of every cell, x and y at its centre."""
        col, row = (F.col("cell") % self.nx).cast("int"), F.floor(F.col("cell") / self.nx).cast("int")
        x, y = self.xmin + (F.col("col") + 0.5) * self.res, self.ymax - (F.col("row") + 0.5) * self.res
        numbered = spark.range(self.nx * self.ny).select(F.col("id").cast("int").alias("cell"))
        return numbered.withColumn("row", row).withColumn("col", col).withColumn("x", x).withColumn("y", y)

    def edges(self) -> tuple[list[float], list[float]]:
        return [self.xmin + k * self.res for k in range(self.nx + 1)], [self.ymax - k * self.res for k in range(self.ny + 1)]


# The 25 km equal-area target grid, the 0.1 degree grid, and the sinusoidal tiles.
TARGET = Grid(-3_000_000.0, 3_350_000.0, 25_000.0, 242, 130)
TENTH_DEGREE = Grid(-125.0, 50.0, 0.1, 590, 260)
TILE_PIXELS, TILE_COLUMNS = 1200, 36


@dataclass(frozen=True)
class Albers:
    """Equal-area conic on an ellipsoid (Snyder 1987): forward and inverse as columns."""

    a: float = 6378137.0
    e2: float = 0.00669438002290
    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0

    def _q(self, s):
        e = sqrt(self.e2)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) + atanh(e * s) / e)

    def _constants(self) -> tuple[float, float, float]:
        m = lambda d: cos(radians(d)) / sqrt(1 - self.e2 * sin(radians(d)) ** 2)
        q1, q2, q0 = (self._q(sin(radians(d))) for d in (self.lat1, self.lat2, self.lat0))
        n = (m(self.lat1) ** 2 - m(self.lat2) ** 2) / (q2 - q1)
        c = m(self.lat1) ** 2 + n * q1
        return n, c, self.a * sqrt(c - n * q0) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        e, s = sqrt(self.e2), F.sin(F.radians(lat))
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = F.sqrt(c - n * q) * (self.a / n), F.radians(lon - self.lon0) * n
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat); latitude by the series of the authalic latitude, good to about 1e-7 degrees."""
        n, c, rho0 = self._constants()
        e2 = self.e2
        rho, theta = F.sqrt(x * x + (rho0 - y) * (rho0 - y)), F.atan2(x, rho0 - y)
        q = (c - rho * rho * (n * n / self.a**2)) / n
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(1.0))))
        k2 = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040
        k4, k6 = 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360
        lat = beta + k2 * F.sin(2 * beta) + k4 * F.sin(4 * beta) + k6 * F.sin(6 * beta)
        return F.degrees(theta / n) + self.lon0, F.degrees(lat)


def sinusoidal_centres(h: Column, v: Column, row: Column, col: Column, pixels: int = TILE_PIXELS) -> tuple[Column, Column]:
    """(lon, lat) of a tile's pixel centre on the sphere, in degrees throughout: the radius cancels out, and latitudes such as 43.25 come out exact, so that a centre on a border is told from one beside it."""
    width = 360 / TILE_COLUMNS
    x = (h + (col + 0.5) / pixels) * width - 180
    lat = 90 - v * width - (row + 0.5) * width / pixels
    return x / F.cos(F.radians(lat)), lat


def cos_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))
