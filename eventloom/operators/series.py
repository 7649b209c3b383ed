"""Versioned series: snapshots taken only on change, and pruning that keeps the newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _snapshot(stored: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations to append: not the stored newest ledger, not stored at all.

    Being the newest stored ledger implies being stored, so one anti join on
    the full key covers both tests.
    """
    keys = list(keys)
    rest = [c for c in observed.columns if c not in (*keys, "ledger")]
    row = F.struct(*rest)
    once = observed.groupBy(*keys, "ledger").agg(F.min(row).alias("r"))
    fresh = once.join(stored.select(*keys, "ledger"), [*keys, "ledger"], "left_anti")
    return fresh.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in observed.columns])


def snapshot_state(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """New instance-storage rows (contract_id, ledger, storage...)."""
    return _snapshot(stored, observed, ["contract_id"])


def snapshot_data(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """New single-key rows per (contract_id, key_hash)."""
    return _snapshot(stored, observed, ["contract_id", "key_hash"])


def cutoff(tip: int, keep: int) -> int | None:
    """First ledger kept, or None when everything is kept."""
    first = tip - keep
    return None if keep <= 0 or first <= 0 else first


def prune_events(ev: DataFrame, tip: int, keep: int) -> DataFrame:
    first = cutoff(tip, keep)
    return ev if first is None else ev.where(F.col("ledger") >= first)


def _prune_keeping_newest(df: DataFrame, keys: Sequence[str], tip: int, keep: int) -> DataFrame:
    """Rows at or after the cutoff, plus the newest row of keys without one.

    The first part is a filter that reaches the scan. The second aggregates one
    row per key with map-side combine; no key's history is sorted or joined.
    """
    first = cutoff(tip, keep)
    if first is None:
        return df
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    quiet = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ledger").alias("r")).where(F.col("r.ledger") < first)
    tips = quiet.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
    return df.where(F.col("ledger") >= first).unionByName(tips)


def prune_state(st: DataFrame, tip: int, keep: int) -> DataFrame:
    return _prune_keeping_newest(st, ["contract_id"], tip, keep)


def prune_data(cd: DataFrame, tip: int, keep: int) -> DataFrame:
    return _prune_keeping_newest(cd, ["contract_id", "key_hash"], tip, keep)


def cascade(child: DataFrame, kept_events: DataFrame) -> DataFrame:
    """Child rows whose event is still there; rows without an event stay.

    A vertical has one row per event, deliveries a few, so event ids spread
    the join evenly.
    """
    ids = kept_events.select("event_id")
    held = child.where("event_id is not null").join(ids, "event_id", "left_semi").select(*child.columns)
    if not child.schema["event_id"].nullable:
        return held
    return held.unionByName(child.where("event_id is null"))



def carry_over(old: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest old row of each key that no kept row has: what outlives the folders of ``old``."""
    keys = list(keys)
    rest = [c for c in old.columns if c not in keys]
    newest = old.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ledger").alias("r"))
    quiet = newest.join(kept.select(*keys), keys, "left_anti")
    return quiet.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in old.columns])
