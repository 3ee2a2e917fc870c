"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.  Where it is unset, a temporary
    one in local mode only: elsewhere executors wouldn't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="gaugeframe-")
    return base


def _on_disk(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and
    every executor can read it, whichever wrote it.  The files go when the JVM ends,
    or with ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaugeframe/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    fs, jpath = _on_disk(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(schema).parquet(path)
    out.written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for t in tables:
        fs, jpath = _on_disk(t.sparkSession, t.written)
        fs.delete(jpath, True)
