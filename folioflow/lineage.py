"""What reaches executors and what outlives them: the package itself, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_marked: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that its functions load there.

    Needed wherever the executors' Python does not find the package by itself.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local session gets a temporary one; on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/folioflow-{spark.sparkContext.applicationId}"
    if path not in _marked:
        at, fs = _located(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(path)
    return path


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _located(spark, path)
    return fs.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    at, fs = _located(spark, path)
    fs.delete(at, True)


def cleared(spark: SparkSession) -> None:
    """Delete all that this application wrote here; results that were not read to their end go with it."""
    at, fs = _located(spark, path := own_dir(spark))
    fs.delete(at, True)
    _marked.discard(path)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet into the shared folder and read it back.

    The schema is given on reading, so no job infers it and an empty table keeps it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`written` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        own = own_dir(spark).removeprefix("file://")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own in folder:
                at, fs = _located(spark, folder)
                fs.delete(at, True)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with the position (from 0) of each row in the given order, made without one task for all.

    Rows are sorted by ranges and written with their range's number; the ranges' sizes, one
    row each, give the offsets. ``order`` should be total, else ties lie as they come.
    """
    at = F.monotonically_increasing_id()
    rows = df.orderBy(*order).select("*", F.shiftright(at, 33).cast("int").alias("__range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    rows = written(rows, "ordered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__first") + F.col("__at")).alias(out))
