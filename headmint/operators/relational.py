"""Small relational operators whose null, order and duplicate rules matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in an explicit order (dropDuplicates would keep any)."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; missing columns are null, types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_outer_items(df: DataFrame, column: str, alias: str = "item") -> DataFrame:
    """One row an item; an empty or null list gives one row with a null item."""
    return df.withColumn(alias, F.explode_outer(column)).drop(column)


def semi_join_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id occurs among ids: the set never leaves the executors."""
    return df.join(ids.select(on), on, "left_semi")


def top_per_group(df: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each group, with their place from 1; Spark prunes each task first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= limit)


def any_of(predicates: list[Column]) -> Column:
    """OR over predicates; no predicate at all is false."""
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def conditional_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with a count for each check, in one pass; 0 on no rows."""
    return df.agg(*(F.count_if(v).alias(k) for k, v in checks.items()))
