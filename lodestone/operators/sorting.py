"""Sorts, duplicates, histograms, order statistics.

Sorting is a range partitioning (sampled splitters) and a sort in each partition; the id at the end of every
key keeps equal keys from meeting in one partition and makes every sort stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.primitives import histogram_by_index, kth_smallest, with_position

__all__ = ["comparison_sort", "histogram", "integer_sort", "kth_smallest", "remove_duplicates", "top_k"]


def comparison_sort(df: DataFrame, order: Sequence[str | Column], index: str, payload: Sequence[str] = ()) -> DataFrame:
    """(pos, keys, payload) in any total order given as sort keys; ties go by index."""
    keep = [c for c in order if isinstance(c, str)]
    return with_position(df, [*order, index]).select("pos", *dict.fromkeys([*keep, *payload]))


def integer_sort(df: DataFrame, key: str, index: str, payload: Sequence[str] = (), bits: int = 0) -> DataFrame:
    """Stable sort by an unsigned key, by its low `bits` if given; (pos, key, payload)."""
    by = F.col(key).cast("long")
    by = by.bitwiseAND(F.lit((1 << bits) - 1)) if 0 < bits < 63 else by
    return with_position(df, [by, F.col(index)]).select("pos", key, *payload)


def remove_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One of each."""
    return df.select(*columns).distinct()


def histogram(df: DataFrame, key: str, m: int) -> DataFrame:
    """(bucket, cnt) of the m buckets."""
    return histogram_by_index(df, key, m)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of an order; each task keeps k."""
    return df.orderBy(*order).limit(k)
