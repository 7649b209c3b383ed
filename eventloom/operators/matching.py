"""Subscription matching: filters where null means "any"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.plans.joins import lookup_join

# Stands for "any" in match keys; never a contract id or event name.
ANY = "\x00any"


def _wildcard_join(items: DataFrame, item_id: str, filters: Sequence[str], subs: DataFrame) -> DataFrame:
    """(subscription_id, item_id) of every match.

    Each item is listed under every combination of its filter values and
    "any", each subscription under its single combination, so matching is a
    plain equality join instead of a nested loop. A subscription meets an item
    under exactly one combination, so no pair repeats. The salted form of the
    join spreads the all-wildcard key, which every item carries.
    """
    options = [F.array(F.col(c), F.lit(ANY)) for c in filters]
    keyed = items.select(item_id, *filters)
    for name, option in zip(filters, options):
        # A null item value only meets "any".
        keyed = keyed.withColumn(f"_k_{name}", F.explode(F.array_distinct(F.array_compact(option))))
    keys = [f"_k_{c}" for c in filters]
    wanted = subs.select(
        F.col("id").alias("subscription_id"), *[F.coalesce(F.col(c), F.lit(ANY)).alias(f"_k_{c}") for c in filters]
    )
    return lookup_join(keyed.select(item_id, *keys), wanted, keys).select("subscription_id", item_id)


def match_events(ev: DataFrame, subs: DataFrame) -> DataFrame:
    """(subscription_id, event_id) for active event subscriptions."""
    active = subs.where(F.col("active") & (F.col("kind") == "event"))
    return _wildcard_join(ev, "event_id", ("contract_id", "event_name"), active)


def match_upgrades(versions: DataFrame, subs: DataFrame) -> DataFrame:
    """(subscription_id, upgrade_id) of interface versions after the first.

    ``versions`` has id, contract_id and version; a first version is a
    baseline, not an upgrade.
    """
    active = subs.where(F.col("active") & (F.col("kind") == "upgrade"))
    upgrades = versions.where("version > 1").select(F.col("id").alias("upgrade_id"), "contract_id")
    return _wildcard_join(upgrades, "upgrade_id", ("contract_id",), active)
