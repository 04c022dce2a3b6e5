"""Column functions for damaged header text. All run in the JVM; a `let` is a lambda, which Spark
interprets, so what it holds lies outside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headmint.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it.

    Without it the optimiser writes the whole expression in every place where it is used.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_empty(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later steps read as values: the generator keeps their expressions
    from being merged into those steps."""
    made = F.explode_outer(F.array(F.struct(*(v.alias(k) for k, v in columns.items()))))
    return df.select("*", made.alias("_made")).select(*df.columns, *(F.col(f"_made.{k}") for k in columns))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def replace_each(c: Column, pairs) -> Column:
    """Literal replacements one after another."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, P.SPACE + "+", " ")


def normalize_text(c: Column) -> Column:
    """Entities decoded once, look-alikes made ASCII, markup and runs of white space gone; empty is null."""
    c = F.regexp_replace(replace_each(c, P.ENTITIES), P.MARKUP, "")
    return null_if_empty(F.trim(collapse_space(c)))


def truncate(c: Column, limit: int = 100) -> Column:
    """Longer texts cut, the last three of `limit` characters being dots."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count_char(c: Column, char: str) -> Column:
    """Occurrences of one character, without a regular expression."""
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(char), F.lit("")))


def contains_any(c: Column, tokens: Column) -> Column:
    """Whether c holds any string of the array tokens; false for an empty array."""
    return F.exists(tokens, lambda t: F.contains(c, t))
