"""Stored snapshot series with retention by folders.

A series (instance states, single keys) is foldered by ledger range. Retention
moves a cut: rows at or after it are read where they are, and of the rows
before it only the newest of keys without a later one are written, into a
small table of carried rows. Folders before the cut are then read by nobody
and can be removed by the store's own means; no kept file is rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.series import carry_over
from eventloom.sources.store import LEDGERS_PER_BUCKET, read_events, with_bucket


def write_snapshots(df: DataFrame, path: str, keys: Sequence[str], mode: str = "append", width: int = LEDGERS_PER_BUCKET) -> None:
    order = [F.col("ledger_bucket"), *[F.col(k) for k in keys], F.col("ledger")]
    with_bucket(df, width).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("ledger_bucket").parquet(path)


def read_snapshots(spark: SparkSession, path: str, first_ledger: int | None = None, carried: str | None = None, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """Rows at or after a cut, with the rows carried over it."""
    rows = read_events(spark, path, first_ledger, width=width)
    return rows if carried is None else rows.unionByName(spark.read.parquet(carried).select(*rows.columns))


def move_cut(spark: SparkSession, path: str, keys: Sequence[str], first_ledger: int, carried_to: str, carried_from: str | None = None,
             old_first: int | None = None, width: int = LEDGERS_PER_BUCKET) -> None:
    """Write the rows carried over the new cut.

    ``old_first`` and ``carried_from`` are the cut before and its carried rows;
    only folders between the two cuts are read whole, and of later ones the keys.
    """
    if old_first is not None and first_ledger < old_first:
        raise ValueError("a cut only moves forward")
    kept = read_events(spark, path, first_ledger, width=width)
    old = read_events(spark, path, old_first, first_ledger - 1, width)
    if carried_from is not None:
        old = old.unionByName(spark.read.parquet(carried_from).select(*old.columns))
    carry_over(old, kept, keys).write.mode("overwrite").parquet(carried_to)
