"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; it goes when the JVM ends.

    Only local runs may do without the setting: they use a temporary folder. On a cluster each
    machine would have its own, so there the setting is asked for.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_headmint_dir", None) or f"file://{tempfile.mkdtemp(prefix='headmint-')}"
        sc._headmint_dir = base
    path = f"{base.rstrip('/')}/headmint-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends there, and lost executors don't matter."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
