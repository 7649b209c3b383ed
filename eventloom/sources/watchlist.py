"""Contract directory pages -> the contracts worth watching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watchlist(df: DataFrame, order: str = "desc", limit: int = 20, active_only: bool = True) -> DataFrame:
    """First ``limit`` distinct contracts in id order, with their event counts.

    ``df`` has contract, events and paging_token; the first listing of a
    contract wins.
    """
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    first = (
        df.where("contract is not null and contract <> ''")
        .groupBy("contract")
        .agg(F.coalesce(F.min_by("events", "paging_token"), F.lit(0)).alias("events"))
    )
    if active_only:
        first = first.where("events > 0")
    key = F.col("contract")
    return first.orderBy(key.asc() if order == "asc" else key.desc()).limit(limit)


def watchlist_total(listed: DataFrame) -> DataFrame:
    return listed.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
