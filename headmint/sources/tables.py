"""Reading and writing tables; a registry of named datasets with a file cache."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the message table and whether the workload needs them.
MESSAGE_COLUMNS = ("id", "sender", "to_recipients", "cc_recipients", "bcc_recipients", "account_email", "all_participants", "is_promotional")

TARGETS = T.StructType([T.StructField("name", T.StringType()), T.StructField("ratio", T.DoubleType()), T.StructField("total_emails", T.LongType())])
PEOPLE = T.StructType([T.StructField("slug", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("email_count", T.LongType()), T.StructField("url", T.StringType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores where its files give fewer splits than there are cores, as a
    small file does; for heavy expressions. Tables of more splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read from the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header. The schema is declared: nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order_by: Iterable[str] | None = None) -> None:
    """CSV with a header. With order_by a single ordered part file; else one file a partition.

    A single file passes through one task: meant for reports and short lists.
    """
    out = df.repartition(1).sortWithinPartitions(*order_by) if order_by is not None else df
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


class Datasets:
    """Datasets by name in a folder. A missing one is fetched once.

    fetch(name) yields chunks of bytes. They go to a file beside the target that is renamed
    when complete, so an interrupted fetch never counts as a hit.
    """

    def __init__(self, folder: str, names: Iterable[str], fetch: Callable[[str], Iterable[bytes]] | None = None):
        self.folder, self.names, self.fetch = folder, tuple(names), fetch

    def path(self, name: str) -> Path:
        if name not in self.names:
            raise KeyError(f"no dataset is named {name!r}; there are {', '.join(self.names)}")
        target = Path(self.folder, f"{name}.parquet")
        if target.exists():
            return target
        if self.fetch is None:
            raise FileNotFoundError(target)
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
        try:
            with part.open("wb") as f:
                for chunk in self.fetch(name):
                    f.write(chunk)
            os.replace(part, target)
        finally:
            part.unlink(missing_ok=True)
        return target

    def read(self, spark: SparkSession, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        return read_parquet(spark, f"file://{self.path(name).resolve()}", columns)
