"""Partial sums, cubes, series, run records and checksums on disk; all paths may be any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "month string, status string, days long, granules long, partial_days long, megabytes double, seconds double, "
    "valid_weight double, flag_weight double, started string, finished string, version string, note string"
)


def write_partials(parts: DataFrame, path: str, day: str = "day") -> None:
    """Partial sums by day; days that are written again replace their own partition only, so a rerun is harmless."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cube(cube: DataFrame, path: str, by: str = "year", values: Sequence[str] = ()) -> None:
    """The monthly cube by year; the values are stored as floats."""
    stored = cube.withColumns({c: F.col(c).cast("float") for c in values})
    stored.repartition(by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def read_cubes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """df as a table of the catalogue, dealt to buckets by its keys and sorted within them: joins of such tables on the keys need no exchange."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def write_by(df: DataFrame, path: str, by: str) -> DataFrame:
    """df in one folder for each value of a column, read back: filters and joins on the column choose the folders that are read."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object a file: fixed columns, unknown keys ignored, unreadable files skipped, by month."""
    got = spark.read.schema(RECORD + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return got.where("_corrupt is null and month is not null").drop("_corrupt").orderBy("month")


def write_records(records: DataFrame, path: str) -> None:
    records.write.option("maxRecordsPerFile", 1).mode("append").json(path)  # one object a file, as read_records() expects


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, length) of the files under a path; empty files count as absent."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def verified(found: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, state) of every listed file: ok, differs or missing."""
    both = listed.join(found.select("name", F.col("sha256").alias("_got")), "name", "left")
    return both.select("name", F.when(F.col("_got").isNull(), "missing").when(F.col("_got") == F.col("sha256"), "ok").otherwise("differs").alias("state"))


def summary_json(df: DataFrame, order: str) -> DataFrame:
    """One JSON text a row, nulls included."""
    return df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of polygon features kept as JSON lines (start, density, rings): unreadable ones are counted, not fatal."""
    schema = "start string, density string, rings array<array<struct<x:double,y:double>>>, _corrupt string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull() & F.col("rings").isNotNull() & (F.size("rings") > 0)
    rejects = raw.groupBy(F.when(F.col("_corrupt").isNotNull(), "unreadable").when(ok, "kept").otherwise("no geometry").alias("state")).agg(F.count("*").alias("n"))
    return raw.where(ok).drop("_corrupt"), rejects


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines under a path, or no rows where the path doesn't exist."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether an output has the marker that Spark's writers leave when all is written."""
    return _exists(spark, f"{path}/_SUCCESS")


def unmark(spark: SparkSession, path: str) -> None:
    """Takes an output's marker away, so that the next run makes it anew."""
    system, where = _file_system(spark, f"{path}/_SUCCESS")
    system.delete(where, False)


def write_properties(spark: SparkSession, path: str, properties: dict[str, str]) -> None:
    """What a table is and where it comes from, in a small table beside it."""
    spark.createDataFrame(list(properties.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}-properties")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, value string").json(f"{path}-properties")
