"""Ordered per-key computations without one task per key.

A window partitioned by a key puts that key's whole history into one task. Here
each key is cut into chunks (a stretch of time or ledgers): rows are ordered
inside their chunk, and only one summary row per chunk is ordered across the
key to carry values over the chunk borders. Results equal the plain window.
Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _carried(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Same keys as the chunk shuffle, so the rows are not moved again.
    return df.join(summary, [*keys, "_chunk"], "left")


def _cut(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Rows placed by (keys, chunk) once; windows and summaries both read that shuffle."""
    return df.withColumn("_chunk", chunk).repartition(*keys, "_chunk")


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    across = W.partitionBy(*keys).orderBy("_chunk")
    return inside, across


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: Mapping[str, str]) -> DataFrame:
    """Add ``values`` = {new column: column of the previous row of the key}.

    ``chunk`` must not decrease along ``order`` within a key.
    """
    inside, across = _windows(keys, order)
    cut = _cut(df, keys, chunk)
    row = F.struct(*[F.col(c).alias(f"v_{c}") for c in dict.fromkeys(values.values())])
    last = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max_by(row, F.struct(*order)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(across))
        .drop("_last")
    )
    rows = cut.withColumn("_lag", F.lag(row).over(inside))
    joined = _carried(rows, last, keys)
    prior = F.coalesce("_lag", "_before")
    return joined.select(*df.columns, *[prior[f"v_{c}"].alias(name) for name, c in values.items()])


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: Mapping[str, str]) -> DataFrame:
    """Add ``sums`` = {new column: column summed up to and including the row}."""
    inside, across = _windows(keys, order)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    cut = _cut(df, keys, chunk)
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carry = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    rows = cut.select("*", *[F.sum(c).over(inside).alias(f"_r_{n}") for n, c in sums.items()])
    joined = _carried(rows, carry, keys)
    return joined.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])
