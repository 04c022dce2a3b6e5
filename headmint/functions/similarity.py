"""Sequence similarity that has no built-in form."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from headmint.functions.text import count_char

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        out, matcher, last = [], SequenceMatcher(None), None
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            if b != last:  # the matcher indexes its second text once
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's ratio of a against b, 0 to 1; not symmetric; null for a null.

    Sort by b first where many rows share it: its index is then built once.
    """
    return _ratio(a, b)


def letter_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio from lengths alone."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb > 0, 2 * F.least(la, lb) / (la + lb)).otherwise(F.lit(1.0))


def shared_letters_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio of texts over ALPHABET: no letter matches more often than in both."""
    both = reduce(add, (F.least(count_char(a, x), count_char(b, x)) for x in ALPHABET))
    total = F.char_length(a) + F.char_length(b)
    return F.when(total > 0, 2 * both / total).otherwise(F.lit(1.0))
