"""Cutting lineage, and joins where null equals null."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """Return the folder for intermediate tables of this application.

    ``spark.checkpoint.dir`` names it. Where that is unset, as in tests, it lies in
    the warehouse, which all executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{named.rstrip('/')}/benchsieve/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """Return the name of a folder that nothing has used."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries go when these end, and not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame, schema: StructType | None = None, lean: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    ``schema`` reads it with other types of the same stored form. With ``lean`` the shuffle files
    that it took go at once. ``codec`` packs it in another way than the session does.

    This cuts lineage, survives the loss of executors, and gives the planner the
    real size. Tables stay until ``release`` or the owner of the folder removes them.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    writer = df.write if codec is None else df.write.option("compression", codec)
    with _without_old_shuffles(spark) if lean else contextlib.nullcontext():
        writer.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a settled table that no query needs any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if any(f"/benchsieve/{spark.sparkContext.applicationId}/" not in f for f in files):
        raise ValueError(f"not a settled table: {files[0]}")
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, when no query needs them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left key columns.

    A plain join is better where keys are never null, since it can use a
    partitioning that is already there.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])
