"""Helpers over whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later steps and filters use them.

    They come from a generator of one row, through which filters aren't pushed and into which later expressions aren't
    inlined. It also keeps nested lambda functions shallow: the planner's work on them grows steeply with their depth.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def opened(df: DataFrame, struct: Column, *names: str) -> DataFrame:
    """Adds the fields of a struct as columns, computed once per row; nulls where the struct is null."""
    return df.select("*", F.inline(F.array(struct)).alias(*names))
