"""Trends of many short series at once, rank correlation, false-discovery control and the permutation test of a field.

A series is an array of (x, y) by key: some dozens of points (years), so that pair work stays within a row. Long series
take pair_slopes_join instead, whose pairs are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions import tests_of_significance as S
from gridlark.functions.columns import finite, ratio
from gridlark.operators.tables import mid_rank


def series(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, pts): the finite points of each series in order of x."""
    ok = finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return df.where(ok).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("pts"))


_SLOPES = """flatten(transform(pts, (p, i) -> transform(filter(slice(pts, i + 2, size(pts)), q -> q.x <> p.x), q -> (q.y - p.y) / (q.x - p.x))))"""
_SIGNS = """aggregate(flatten(transform(pts, (p, i) -> transform(slice(pts, i + 2, size(pts)), q ->
  named_struct('s', sign(q.x - p.x) * sign(q.y - p.y), 'x', abs(sign(q.x - p.x)), 'y', abs(sign(q.y - p.y)))))),
  named_struct('s', 0D, 'x', 0D, 'y', 0D), (a, v) -> named_struct('s', a.s + v.s, 'x', a.x + v.x, 'y', a.y + v.y))"""


def middle_of(array: str) -> str:
    """Median of an array that is sorted already."""
    return f"(get({array}, (size({array}) - 1) div 2) + get({array}, size({array}) div 2)) / 2"


def median_of(array: str) -> str:
    """Median of an array, which is sorted once; null if it is empty."""
    return f"get(transform(array(array_sort({array})), a -> {middle_of('a')}), 0)"


def sen(df: DataFrame) -> DataFrame:
    """Adds slope (median of the pair slopes), intercept and tau-b to series rows; constant series have no tau."""
    xs, ys = "transform(pts, p -> p.x)", "transform(pts, p -> p.y)"
    out = df.withColumn("_s", F.array_sort(F.expr(_SLOPES))).withColumn("_k", F.expr(_SIGNS))
    out = out.withColumn("slope", F.expr(middle_of("_s")))
    tau = F.col("_k.s") / F.nullif(F.sqrt(F.col("_k.x") * F.col("_k.y")), F.lit(0.0))
    # Points are in order of x already.
    intercept = F.expr(f"{median_of(ys)} - slope * {middle_of(xs)}")
    return out.withColumn("intercept", intercept).withColumn("tau", tau).withColumn("n", F.size("pts").cast("long"))


def _ties(values: np.ndarray) -> list[int]:
    return [int(c) for c in np.unique(values, return_counts=True)[1] if c > 1]


def sen_tests(df: DataFrame) -> DataFrame:
    """sen() with the 95 % bounds of the slope and the p of tau: tail probabilities have no built-in, so one Arrow pass adds them."""

    got = sen(df)
    keep = [c for c in got.columns if c not in ("pts", "_s", "_k")]
    rows = got.select(*keep, F.expr("transform(pts, p -> p.x)").alias("_x"), F.expr("transform(pts, p -> p.y)").alias("_y"), "_s", F.col("_k.s").alias("_sum"))

    def tests(frames):
        for f in frames:
            bounds = []
            for x, y, slopes, k in zip(f["_x"], f["_y"], f["_s"], f["_sum"]):
                tx, ty = _ties(np.asarray(x)), _ties(np.asarray(y))
                lo, hi = S.sen_bounds(len(x), len(slopes), tx, ty) if len(slopes) else (0, -1)
                ok = 0 <= lo <= hi
                bounds.append((float(slopes[lo]) if ok else None, float(slopes[hi]) if ok else None, S.kendall_two_sided(k, len(x), tx, ty)))
            out = f[keep].reset_index(drop=True)
            out[["slope_lo", "slope_hi", "tau_p"]] = pd.DataFrame(bounds, columns=["slope_lo", "slope_hi", "tau_p"], dtype="float64")
            yield out

    schema = T.StructType([*got.select(*keep).schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("slope_lo", "slope_hi", "tau_p"))])
    found = rows.mapInPandas(tests, schema)
    return found.select(*keep, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("slope_lo", "slope_hi", "tau_p")])


def pair_slopes_join(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, slope) by a self-join, for series too long for an array."""
    a, b = df.alias("a"), df.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a.{x}") < F.col(f"b.{x}")]
    pairs = a.join(b, on).select(*[F.col(f"a.{k}") for k in keys], ((F.col(f"b.{y}") - F.col(f"a.{y}")) / (F.col(f"b.{x}") - F.col(f"a.{x}"))).alias("s"))
    return pairs.groupBy(*keys).agg(F.median("s").alias("slope"))


def log_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Trend of ln y over positive y: percent a year with its 95 % bounds, the factor over the whole span of x, tau and its p."""
    span = df.groupBy(*keys).agg((F.max(x) - F.min(x)).cast("double").alias("_span"))
    logs = series(df.where(F.col(y) > 0).withColumn("_ln", F.ln(y)), keys, x, "_ln")
    tests = sen_tests(logs)
    got = tests.join(span, list(keys)) if keys else tests.crossJoin(F.broadcast(span))  # one row
    percent = [(100 * F.col(c)).alias(n) for c, n in (("slope", "percent_per_year"), ("slope_lo", "percent_lo"), ("slope_hi", "percent_hi"))]
    return got.select(*keys, *percent, F.exp(F.col("slope") * F.col("_span")).alias("factor"), "tau", "tau_p", "n")


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    got = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))

    @F.pandas_udf("double")
    def p(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([S.t_two_sided((r * (k - 2) / max(1 - r, 1e-300)) ** 0.5, k - 2) if r == r and k > 2 else None for r, k in zip(r2, n)], dtype="float64")

    return got.withColumn("p", p("r2", "n"))


def log_line(df: DataFrame, x: str, y: str, rate: Column) -> DataFrame:
    """Adds line: the exponential line of a log rate through the geometric mean."""
    mean = df.agg(F.avg(F.ln(y)).alias("_ln"), F.avg(x).alias("_mid"))
    return df.crossJoin(F.broadcast(mean)).withColumn("line", F.exp(F.col("_ln") + rate * (F.col(x) - F.col("_mid")))).drop("_ln", "_mid")  # one row


#: Ranges into which values are dealt for ranks over a whole table.
RANGES = 256


def ranked_values(df: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): how often each different value occurs, and how many rows have it or a smaller one; nulls are left out.

    Values are dealt to ranges by approximate percentiles, counts are summed within each range, and the totals of the ranges
    below, at most RANGES rows, are added; no window holds more than one range.
    """
    some = df.where(F.col(value).isNotNull())
    cuts = some.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    counts = some.groupBy(F.col(value)).agg(F.count("*").alias("n")).crossJoin(F.broadcast(cuts))  # one row
    counts = counts.select(value, "n", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_range"))
    totals = counts.groupBy("_range").agg(F.sum("n").alias("_n"))
    below = totals.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_below"))  # RANGES rows
    inside = counts.withColumn("_upto", F.sum("n").over(W.partitionBy("_range").orderBy(value)))
    return inside.join(F.broadcast(below), "_range").select(value, "n", (F.col("_below") + F.col("_upto")).alias("upto"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, Pearson, Spearman and log10 Pearson (offset: half of the smallest positive value of each) of the finite pairs."""
    ok = df.where(finite(F.col(a)) & finite(F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    off = ok.agg(*[F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))) / 2, F.lit(1.0)).alias(f"o{c}") for c in "ab"])
    ranked = ok.crossJoin(F.broadcast(off))  # one row
    for c in "ab":
        mid = F.col("upto") - (F.col("n") - 1) / 2
        ranked = ranked.join(ranked_values(ok, c).select(c, mid.alias(f"r{c}")), c)
    n = F.count("*")
    r = lambda x, y: F.when(n >= 3, F.corr(x, y))
    return ranked.agg(
        n.alias("n"), r("a", "b").alias("pearson_r"), r("ra", "rb").alias("spearman_r"),
        r(F.log10(F.col("a") + F.col("oa")), F.log10(F.col("b") + F.col("ob"))).alias("log_pearson_r"),
    )


def with_p(df: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """The two-sided p of a correlation by Student's t."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([S.t_two_sided(x * ((k - 2) / max(1 - x * x, 1e-300)) ** 0.5, k - 2) if x == x and k > 2 else None for x, k in zip(rs, ns)], dtype="float64")

    return df.withColumn(name, p(r, n))


def with_t_p(df: DataFrame, t: str, degrees: str, name: str) -> DataFrame:
    """The two-sided p of Student's t with any number of degrees of freedom."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([S.t_two_sided(x, k) if x == x and k == k and k > 0 else None for x, k in zip(ts, ns)], dtype="float64")

    return df.withColumn(name, p(t, degrees))


def spearman_with_x(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation of y with x by key; null for constant series."""
    ranked = df.withColumn("_r", mid_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.when(F.stddev_pop("_r") > 0, F.corr(F.col(x).cast("double"), "_r")).alias("rho"))


def bh_rejected(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """Adds rejected: Benjamini-Hochberg's step-up rule at level q; null p values are never rejected but count as tests.

    The rule asks for the largest p that is at most q * rank / n, and of equal p values the last rank counts.
    """
    total = df.agg(F.count("*").alias("_n"))
    ranks = ranked_values(df.select(F.col(p).alias("_p")), "_p").crossJoin(F.broadcast(total))  # one row
    cut = ranks.where(F.col("_p") <= q * F.col("upto") / F.col("_n")).agg(F.max("_p").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def shuffles(xs: Sequence[float], n_perm: int, seed: int = 0) -> np.ndarray:
    """n_perm orders of the points: in order k, points are sorted by the md5 of 'seed:k:place', which any engine can make."""
    places = range(len(xs))
    keys = lambda k: [hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest() for i in places]
    return np.array([sorted(places, key=keys(k).__getitem__) for k in range(1, n_perm + 1)], dtype=np.int64).reshape(n_perm, len(xs))


def _doubled_ranks(ys: np.ndarray) -> np.ndarray:
    """Twice the middle ranks within each row, less their mean: whole numbers that add up to nothing."""
    below = (ys[:, None, :] < ys[:, :, None]).sum(2)
    upto = (ys[:, None, :] <= ys[:, :, None]).sum(2)
    return (below + upto - ys.shape[1]).astype(np.float64)


def field_test(df: DataFrame, key: str, n_perm: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Permutation test of a trend map. df: (key, pts) series that share one x axis (else an error).

    A cell's score is the sum of its centred ranks times the centred x, both whole numbers where x is, so that permuted scores
    are compared without rounding; rho is the score over its largest value. A cell is significant in one order if its score
    reaches the 1 - alpha quantile of its own scores in all orders.

    Returns the cells (key, rho, p_cell, live) and one row for the field. A cell's scores in all orders are one row of a matrix
    product; of the field, every task returns its counts for each order, and one groupBy adds them.
    """
    axes = df.select(F.expr("transform(pts, p -> p.x)").alias("x")).agg(F.min("x").alias("least"), F.max("x").alias("most")).first()
    if axes.least != axes.most:
        raise ValueError("the series don't share one x axis")
    xs = np.asarray(axes.least or [], dtype=float)
    wide = xs * len(xs) - xs.sum()
    dealt = np.vstack([wide, wide[shuffles(xs, n_perm, seed)]])  # row 0: as observed

    def scores(frame: pd.DataFrame) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray]]:
        for at in range(0, len(frame), 256):
            part = frame.iloc[at : at + 256]
            ranks = _doubled_ranks(np.array(part["y"].to_list(), dtype=float).reshape(len(part), len(xs)))
            yield part[key], ranks, ranks @ dealt.T

    def by_cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, ranks, got in scores(frame):
                largest = np.sqrt((ranks**2).sum(1) * (wide**2).sum())
                size = np.abs(got)
                reached = np.array([n_perm - np.searchsorted(np.sort(row[1:]), row[0]) for row in size])
                live = largest > 0
                rho = np.divide(got[:, 0], largest, out=np.full(len(got), np.nan), where=live)
                yield pd.DataFrame({key: names.to_numpy(), "rho": rho, "p_cell": np.where(live, (1 + reached) / (1 + n_perm), np.nan), "live": live})

    def by_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, ups, cells = np.zeros(n_perm + 1, dtype=np.int64), np.zeros(n_perm + 1, dtype=np.int64), 0
        for frame in frames:
            for _, ranks, got in scores(frame):
                got = got[np.abs(ranks).sum(1) > 0]
                if len(got) and n_perm:
                    bar = np.quantile(np.abs(got[:, 1:]), 1 - alpha, axis=1)
                    hits += (np.abs(got) >= bar[:, None]).sum(0)
                ups += (got > 0).sum(0)
                cells += len(got)
        yield pd.DataFrame({"perm": np.arange(n_perm + 1), "hits": hits, "ups": ups, "cells": cells})

    ys = df.select(key, F.expr("transform(pts, p -> p.y)").alias("y"))
    cells = ys.mapInPandas(by_cell, f"{key} {df.schema[key].dataType.simpleString()}, rho double, p_cell double, live boolean")
    orders = ys.mapInPandas(by_order, "perm long, hits long, ups long, cells long").groupBy("perm").agg(*[F.sum(c).alias(c) for c in ("hits", "ups", "cells")])
    seen = orders.where("perm = 0").select(F.col("hits").alias("o_hits"), F.col("ups").alias("o_ups"), F.col("cells").alias("n_cells"))
    null = orders.where("perm > 0").crossJoin(F.broadcast(seen))  # one row
    share = lambda c: ratio(c, "n_cells")
    above = lambda c, o: (1 + F.count_if(F.col(c) >= F.col(o))) / F.lit(n_perm + 1)
    field = null.groupBy("n_cells", share("o_hits").alias("significant"), share("o_ups").alias("up")).agg(
        F.percentile(share("hits"), 0.95).alias("null_significant_p95"), above("hits", "o_hits").alias("significant_p"),
        F.percentile(share("ups"), 0.95).alias("null_up_p95"), above("ups", "o_ups").alias("up_p"),
    )
    return cells.select(key, F.nanvl("rho", F.lit(None).cast("double")).alias("rho"), F.nanvl("p_cell", F.lit(None).cast("double")).alias("p_cell"), "live"), field
