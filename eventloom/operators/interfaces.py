"""Interfaces as tables: items, functions, identity signatures, versions, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.interface import parse_interface
from eventloom.functions.jsontext import array_text, quote
from eventloom.functions.once import computed_once
from eventloom.operators.ordered import with_previous, with_running_sums
from eventloom.plans.joins import lookup_join

SECTIONS = ("functions", "events", "types")
# Word used for a section's items in summary lines.
SECTION_WORD = {"functions": "function", "events": "event", "types": "type"}
DAY_SECONDS = 86_400


def with_interface(modules: DataFrame) -> DataFrame:
    """Add ``interface`` to rows with ``section`` bytes; unreadable ones drop out."""
    names = [c for c in modules.columns if c != "interface"]
    return computed_once(modules, *names, interface=parse_interface(F.col("section"))).where("interface is not null")


def functions(interfaces: DataFrame) -> DataFrame:
    """One row per callable function with typed inputs and outputs."""
    return interfaces.select("contract_id", F.explode("interface.functions").alias("f")).select(
        "contract_id",
        F.col("f.name").alias("name"),
        F.col("f.doc").alias("doc"),
        F.col("f.inputs").alias("inputs"),
        F.col("f.outputs").alias("outputs"),
    )


def _listed(parts: Column, one) -> Column:
    return F.array_join(F.transform(parts, one), ", ")


def _function_signature(f: Column) -> Column:
    inputs = _listed(f["inputs"], lambda i: F.concat(i["name"], F.lit(": "), i["type"]))
    output = (
        F.when(F.size(f["outputs"]) == 0, F.lit("void"))
        .when(F.size(f["outputs"]) == 1, F.get(f["outputs"], F.lit(0)))
        .otherwise(F.concat(F.lit("("), F.array_join(f["outputs"], ", "), F.lit(")")))
    )
    return F.concat(f["name"], F.lit("("), inputs, F.lit(") -> "), output)


def _event_signature(e: Column) -> Column:
    params = _listed(e["params"], lambda p: F.concat(p["name"], F.lit(": "), p["type"], F.lit(" @"), p["location"]))
    return F.concat(e["name"], F.lit("("), params, F.lit(") ["), e["data_format"], F.lit("]"))


def _type_signature(word: str, item: Column, body: Column) -> Column:
    return F.concat(F.lit(f"{word} "), item["name"], F.lit(" { "), body, F.lit(" }"))


def _struct_signature(s: Column) -> Column:
    return _type_signature("struct", s, _listed(s["fields"], lambda f: F.concat(f["name"], F.lit(": "), f["type"])))


def _union_signature(u: Column) -> Column:
    def case(c: Column) -> Column:
        carried = F.concat(c["name"], F.lit("("), F.array_join(c["types"], ", "), F.lit(")"))
        return F.when(F.size(c["types"]) == 0, c["name"]).otherwise(carried)

    return _type_signature("union", u, _listed(u["cases"], case))


def _enum_signature(e: Column) -> Column:
    return _type_signature(
        "enum", e, _listed(e["cases"], lambda c: F.concat(c["name"], F.lit(" = "), c["value"].cast("string")))
    )


def interface_items(interfaces: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(keys..., section, name, signature), one row per item name.

    All type kinds share one namespace; of equal names the last definition
    stands, enums after unions after structs.
    """
    groups = (
        ("functions", "functions", _function_signature, 0),
        ("events", "events", _event_signature, 0),
        ("types", "structs", _struct_signature, 0),
        ("types", "unions", _union_signature, 1),
        ("types", "enums", _enum_signature, 2),
    )

    def entries(section, field, sign, kind):
        return F.transform(
            f"interface.{field}",
            lambda item, i: F.struct(
                F.lit(section).alias("section"),
                item["name"].alias("name"),
                sign(item).alias("signature"),
                F.struct(F.lit(kind).alias("kind"), i.alias("at")).alias("rank"),
            ),
        )

    every = F.concat(*[entries(*group) for group in groups])
    exploded = interfaces.select(*keys, F.explode(every).alias("item"))
    return exploded.groupBy(*keys, F.col("item.section").alias("section"), F.col("item.name").alias("name")).agg(
        F.max_by("item.signature", "item.rank").alias("signature")
    )


def interface_signatures(interfaces: DataFrame) -> DataFrame:
    return interface_items(interfaces)


def change_rows(items_old: DataFrame, items_new: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(keys..., section, name, action, before, after) of items that differ.

    Old and new are stacked and grouped by name, one shuffle with map-side
    combine instead of an outer join.
    """
    none = F.lit(None).cast("string")
    old = items_old.select(*keys, "section", "name", F.col("signature").alias("before"), none.alias("after"))
    new = items_new.select(*keys, "section", "name", none.alias("before"), F.col("signature").alias("after"))
    both = old.unionByName(new).groupBy(*keys, "section", "name").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    action = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.where("not (before <=> after)").select(*keys, "section", "name", action.alias("action"), "before", "after")


def roll_up(changes: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """One diff per key from its change rows.

    A group is one contract version's items, bounded by the size of a module.
    Columns: breaking, changes (array in report order).
    """
    rank = F.when(F.col("section") == "functions", 0).when(F.col("section") == "events", 1).otherwise(2)
    step = F.when(F.col("action") == "removed", 0).when(F.col("action") == "changed", 1).otherwise(2)
    change = F.struct(
        rank.alias("section_rank"), step.alias("action_rank"), "name", "section", "action", "before", "after"
    )
    return changes.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("action") != "added"), F.lit(False)).alias("breaking"),
        F.array_sort(F.collect_list(change)).alias("changes"),
    )


def diff_summary(changes: Column) -> Column:
    """Text lines of a ``changes`` array: sections in order, removals first."""

    def line(c: Column) -> Column:
        word = F.when(c["section"] == "functions", SECTION_WORD["functions"])
        word = word.when(c["section"] == "events", SECTION_WORD["events"]).otherwise(SECTION_WORD["types"])
        head = F.concat(c["action"], F.lit(" "), word, F.lit(" "))
        moved = F.concat(c["name"], F.lit(": "), c["before"], F.lit(" became "), c["after"])
        shown = F.when(c["action"] == "changed", moved).otherwise(F.coalesce(c["before"], c["after"]))
        return F.concat(head, shown)

    return F.transform(changes, line)


def diff_json(changes: Column, breaking: Column) -> Column:
    """A diff as canonical JSON, the stored form."""

    def texts(section: str, action: str, side: str) -> Column:
        picked = F.filter(changes, lambda c: (c["section"] == section) & (c["action"] == action))
        return array_text(F.transform(picked, lambda c: quote(c[side])))

    def moved(section: str) -> Column:
        picked = F.filter(changes, lambda c: (c["section"] == section) & (c["action"] == "changed"))
        return array_text(
            F.transform(
                picked,
                lambda c: F.concat(
                    F.lit('{"from":'), quote(c["before"]), F.lit(',"name":'), quote(c["name"]),
                    F.lit(',"to":'), quote(c["after"]), F.lit("}"),
                ),
            )
        )

    def section(name: str) -> Column:
        return F.concat(
            F.lit(f'"{name}":{{"added":'), texts(name, "added", "after"), F.lit(',"changed":'), moved(name),
            F.lit(',"removed":'), texts(name, "removed", "before"), F.lit("}"),
        )

    return F.concat(
        F.lit('{"breaking":'), breaking.cast("string"), F.lit(","), section("events"), F.lit(","),
        section("functions"), F.lit(',"summary":'), array_text(F.transform(diff_summary(changes), quote)),
        F.lit(","), section("types"), F.lit("}"),
    )


def diff_interfaces(items_old: DataFrame, items_new: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """(keys..., breaking, changes) for every key that has any difference."""
    return roll_up(change_rows(items_old, items_new, keys), keys)


def build_versions(observations: DataFrame, stored: DataFrame | None = None, chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Interface observations -> versions (contract_id, version, wasm_hash,
    previous_wasm_hash, observed_at).

    ``observations`` has contract_id, wasm_hash, observed_at and obs_id (a
    tie-break). A version starts where the hash differs from the observation
    before it; with ``stored`` versions, counting goes on from their newest.
    """
    order = ("observed_at", "obs_id")
    chunk = F.floor(F.unix_seconds(F.col("observed_at").cast("timestamp")) / F.lit(chunk_seconds))
    obs = observations.select("contract_id", "wasm_hash", *order)
    seen = with_previous(obs, ["contract_id"], order, chunk, {"previous_wasm_hash": "wasm_hash"})
    if stored is not None:
        newest = stored.groupBy("contract_id").agg(
            F.max_by("wasm_hash", "version").alias("_tip_hash"), F.max("version").alias("_tip")
        )
        seen = lookup_join(seen, newest, ["contract_id"], "left").withColumn(
            "previous_wasm_hash", F.coalesce("previous_wasm_hash", "_tip_hash")
        )
    else:
        seen = seen.withColumn("_tip", F.lit(None).cast("int"))
    starts = seen.where("not (wasm_hash <=> previous_wasm_hash)").withColumn("_one", F.lit(1))
    counted = with_running_sums(starts, ["contract_id"], order, chunk, {"_nth": "_one"})
    return counted.select(
        "contract_id",
        (F.col("_nth") + F.coalesce("_tip", F.lit(0))).cast("int").alias("version"),
        "wasm_hash",
        "previous_wasm_hash",
        "observed_at",
    )


def version_diffs(versions: DataFrame, items: DataFrame) -> DataFrame:
    """Each version's diff against its predecessor.

    ``versions`` has contract_id and version, ``items`` the interface items per
    (contract_id, version). Columns breaking and changes; changes is null for a
    first version and for one whose own or earlier interface could not be read,
    and empty when only code changed.
    """
    keys = ("contract_id", "version")
    readable = items.select(*keys).distinct()
    pairs = versions.select(*keys)
    current = items.select(*keys, "section", "name", "signature")
    earlier = items.select(
        "contract_id", (F.col("version") + 1).alias("version"), "section", "name", "signature"
    )
    has_earlier = readable.select("contract_id", (F.col("version") + 1).alias("version"))
    comparable = pairs.join(readable, list(keys), "left_semi").join(has_earlier, list(keys), "left_semi")
    changes = change_rows(earlier, current, keys).join(comparable, list(keys), "left_semi")
    rolled = roll_up(changes, keys)
    empty = F.array().cast(rolled.schema["changes"].dataType)
    return (
        pairs.join(comparable.withColumn("_diffable", F.lit(True)), list(keys), "left")
        .join(rolled, list(keys), "left")
        .select(
            *keys,
            F.coalesce("breaking", F.lit(False)).alias("breaking"),
            F.when(F.col("_diffable"), F.coalesce("changes", empty)).alias("changes"),
        )
    )


def current_specs(observations: DataFrame) -> DataFrame:
    """Newest interface per contract; ``observations`` also has interface.

    has_events tells whether it publishes typed events.
    """
    newest = observations.groupBy("contract_id").agg(
        F.max_by(F.struct("wasm_hash", "interface", "observed_at"), F.struct("observed_at", "obs_id")).alias("n")
    )
    return newest.select(
        "contract_id",
        F.col("n.wasm_hash").alias("wasm_hash"),
        F.col("n.interface").alias("interface"),
        F.coalesce(F.size("n.interface.events") > 0, F.lit(False)).alias("has_events"),
        F.col("n.observed_at").alias("fetched_at"),
    )
