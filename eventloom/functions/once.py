"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` columns plus new ones that later steps read as plain values.

    The optimizer copies a projected expression into every filter above it, so
    a parse would run once per use. A generator that yields one row per row
    stops that: filters on its output stay above it.
    """
    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
