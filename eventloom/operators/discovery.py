"""What the events name: holders, storage keys and active contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import text_of
from eventloom.functions.once import computed_once
from eventloom.functions.wire import flat_texts, good_addresses, is_address, storage_key
from eventloom.operators.verticals import BALANCE_EVENTS

def holders(ev: DataFrame, address_test=is_address) -> DataFrame:
    """Distinct (contract_id, holder): every address topic of a balance event."""
    named = ev.where(F.col("event_name").isin(*BALANCE_EVENTS))
    topics = named.select("contract_id", F.explode("decoded_topics").alias("t"))
    texts = topics.select("contract_id", text_of(F.col("t")).alias("holder")).where("holder is not null").distinct()
    # Tested above the distinct, so each holder is checked once per contract.
    tested = computed_once(texts, *texts.columns, _good=address_test(F.col("holder")))
    return tested.where("_good").drop("_good")


def template_keys(ev: DataFrame, templates: DataFrame, address_test=is_address) -> DataFrame:
    """Distinct (contract_id, symbol, durability, label, addresses).

    ``templates`` has symbol, events, params, durability and label. Each topic
    index of a template contributes its addresses; several indices combine. An
    index that is missing or names no address yields no rows.
    """
    # Templates are configuration; one row per (template, event name).
    from eventloom.plans.joins import few_rows, lookup_join

    per_name = templates.select(
        "symbol", "params", F.coalesce("durability", F.lit("persistent")).alias("durability"), "label",
        F.explode(F.array_distinct("events")).alias("event_name"),
    )
    joined = lookup_join(ev.select("event_id", "contract_id", "event_name", "decoded_topics"), per_name, ["event_name"], few=few_rows(templates))
    wanted = joined.where(F.forall("params", lambda p: p < F.size("decoded_topics")))
    names = ["event_id", "contract_id", "symbol", "durability", "label"]
    # The Arrow steps stand in one projection, so a task runs them in one Python process.
    texts = flat_texts(F.transform("params", lambda p: F.get("decoded_topics", p)))
    if address_test is is_address:
        kept = computed_once(wanted, *names, lists=good_addresses(texts))
    else:
        spread = computed_once(wanted, *names, texts=texts)
        kept = spread.withColumn("lists", F.transform("texts", lambda one: F.filter(one, address_test)))
    # Combine one parameter after the other, inside the row: the addresses of
    # one event, never of a group.
    combos = F.aggregate(
        "lists",
        F.array(F.array().cast("array<string>")),
        lambda acc, one: F.flatten(F.transform(acc, lambda base: F.transform(one, lambda t: F.concat(base, F.array(t))))),
    )
    return (
        kept.where(F.forall("lists", lambda one: F.size(one) > 0))
        .select("contract_id", "symbol", "durability", "label", F.explode(combos).alias("addresses"))
        .distinct()
    )


def with_storage_key(keys: DataFrame) -> DataFrame:
    """Template keys with their wire form; unbuildable ones drop out."""
    built = keys.withColumn("k", storage_key(F.col("symbol"), F.col("addresses"))).where("k is not null")
    return built.select(*keys.columns, "k.key_xdr", "k.key_hash", "k.key_json")


def active_contracts(ev: DataFrame, contract_ids: Sequence[str] = ()) -> DataFrame:
    """Distinct contracts of a batch, or the listed ones."""
    if contract_ids:
        spark = ev.sparkSession
        return spark.createDataFrame([(c,) for c in dict.fromkeys(contract_ids)], "contract_id string")
    return ev.select("contract_id").distinct()
