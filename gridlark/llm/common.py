"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read that table, whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/gridlark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that no later step reads."""
    path = getattr(df, "written_to", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A table of short rows is broadcast up to so many of them, else joined by shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has at most `most` rows, else as it is; of a written table only the footers are read for that."""
    n = df.count() if hasattr(df, "written_to") else df.limit(most + 1).count()
    if n > most:
        return df
    out = F.broadcast(df)
    out.written_to = getattr(df, "written_to", None)
    return out


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the jobs started inside the block, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table by alternating large and small stars.

    Returns (node, root) for every node that has an edge; root is the smallest node reachable. Each round is two
    group-and-join steps over the edges, which are written to the shared folder between rounds; nothing but two numbers a
    round comes to the driver. The star centre of a large group is a hot join key whose other side has one row a key, so
    the adaptive skew join splits it.
    """
    cur = written(
        edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (
            both.where("lo > hi").join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        ).distinct()
        small_m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(small_m, "hi")
            .where("lo <> m")
            .select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
            .union(small_m.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        new = written(small, "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        dropped(cur)
        cur = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("lo").alias("node")).distinct()
    out = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("node", F.col("node").alias("root")))
    out.written_to = cur.written_to
    return out
