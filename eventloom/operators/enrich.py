"""Naming an event's fields from its contract's published event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.functions.interface import relabel
from eventloom.functions.jsontext import quote
from eventloom.functions.once import computed_once
from eventloom.plans.joins import lookup_join


def event_keys(interfaces: DataFrame) -> DataFrame:
    """(contract_id, event_name) -> event schema, one row per key.

    ``interfaces`` has contract_id and interface. A key is the first emitted
    prefix topic or the declared name; prefix keys win, the last of equal
    prefixes and the first of equal names.
    """
    events = interfaces.select(
        "contract_id", F.col("interface.type_defs").alias("type_defs"), F.posexplode("interface.events").alias("pos", "spec")
    )
    prefix = F.get("spec.prefix_topics", F.lit(0))
    keyed = events.select(
        "contract_id",
        "type_defs",
        "spec",
        F.explode(
            F.array(
                F.struct(prefix.alias("name"), F.col("pos").alias("rank")),
                # Names rank below every prefix, earlier ones higher.
                F.struct(F.col("spec.name").alias("name"), (-1 - F.col("pos")).alias("rank")),
            )
        ).alias("key"),
    ).where("key.name is not null")
    best = keyed.groupBy("contract_id", F.col("key.name").alias("event_name")).agg(
        F.max_by(F.struct("spec", "type_defs"), "key.rank").alias("best")
    )
    return best.select("contract_id", "event_name", _binding(F.col("best.spec"), F.col("best.type_defs")).alias("schema"))


def _binding(spec: Column, type_defs: Column) -> Column:
    """Schema with each parameter's slot worked out once per schema.

    A topic parameter's slot is its place among topics, a data parameter's its
    place in the body list; parameters are in name order for canonical JSON and
    the last of equal names is kept.
    """
    params = spec["params"]
    skip = F.greatest(F.size(spec["prefix_topics"]), F.lit(1))

    def slot(p: Column, i: Column) -> Column:
        before = F.slice(params, F.lit(1), i)
        rank = F.size(F.filter(before, lambda q: q["location"] == p["location"]))
        return F.struct(
            p["name"].alias("name"),
            i.alias("at"),
            p["type"].alias("type"),
            p["shape"].alias("shape"),
            p["location"].alias("location"),
            F.when(p["location"] == "topic", rank + skip).otherwise(rank).alias("slot"),
        )

    slots = F.transform(params, slot)
    last = F.filter(slots, lambda p: ~F.exists(slots, lambda q: (q["name"] == p["name"]) & (q["at"] > p["at"])))
    return F.struct(
        spec["name"].alias("event"),
        spec["data_format"].alias("data_format"),
        F.array_sort(last).alias("params"),
        type_defs.alias("type_defs"),
    )


def enrich(events: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Add ``enriched``: ``{"event":name,"params":{p:{"type","value"}}}`` or null."""
    return enrich_with_keys(events, event_keys(interfaces))


def enrich_with_keys(events: DataFrame, keys: DataFrame, only: Column | None = None) -> DataFrame:
    """``only``: rows to name; others get null."""
    joined = lookup_join(events, keys, ["contract_id", "event_name"], "left")
    if only is not None:
        joined = joined.withColumn("schema", F.when(only, F.col("schema")))
    schema = F.col("schema")
    body = F.try_parse_json("decoded_value")
    prepared = (
        joined.withColumn(
            "_list", F.when(schema["data_format"] == "vec", body.try_cast("array<variant>"))
        ).withColumn("_map", F.when(schema["data_format"] == "map", body.try_cast("map<string,variant>")))
    )

    def bound(p: Column) -> Column:
        data = (
            F.when(schema["data_format"] == "vec", F.to_json(F.get(F.col("_list"), p["slot"])))
            .when(schema["data_format"] == "map", F.to_json(F.try_element_at(F.col("_map"), p["name"])))
            .otherwise(F.col("decoded_value"))
        )
        value = F.when(p["location"] == "topic", F.get(F.col("decoded_topics"), p["slot"])).otherwise(data)
        return F.coalesce(value, F.lit("null"))

    bound_values = prepared.withColumn("_values", F.transform(schema["params"], bound))
    labelled = bound_values.withColumn(
        "_values", relabel(F.col("_values"), F.col("schema.params.shape"), F.col("schema.type_defs"))
    )
    rendered = F.zip_with(
        schema["params"],
        F.col("_values"),
        lambda p, v: F.concat(quote(p["name"]), F.lit(':{"type":'), quote(p["type"]), F.lit(',"value":'), v, F.lit("}")),
    )
    text = F.concat(F.lit('{"event":'), quote(schema["event"]), F.lit(',"params":{'), F.concat_ws(",", rendered), F.lit("}}"))
    names = [c for c in events.columns if c != "enriched"]
    # Filters on the record stay above, so user types are named once.
    return computed_once(labelled, *names, enriched=F.when(schema.isNotNull(), text))


def reenrich(events: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, Observation]:
    """Retry named events that were stored unenriched, in one set-based pass.

    Returns the whole table and its stats (processed, updated), which fill while
    the table is written. The table is read once; rows that are not retried pass
    the lookup and keep their record.
    """
    stats = Observation()
    retry = F.col("_kept").isNull() & F.col("event_name").isNotNull()
    tried = enrich_with_keys(events.withColumn("_kept", F.col("enriched")), event_keys(interfaces), retry)
    watched = tried.observe(stats, F.count_if(retry).alias("processed"), F.count_if(retry & F.col("enriched").isNotNull()).alias("updated"))
    return watched.withColumn("enriched", F.coalesce("_kept", "enriched")).select(*events.columns), stats
