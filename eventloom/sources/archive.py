"""Newline-delimited history files: per-ledger envelopes and flat event records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import stripped
from eventloom.functions.once import computed_once

# Allowed JSON kinds per event field: (field, kind, null counts as absent).
# Fixed values of the format.
EVENT_FIELDS = (
    ("id", "STRING", True),
    ("event_id", "STRING", True),
    ("contract_id", "STRING", True),
    ("type", "STRING", True),
    ("value", "STRING", False),
    ("tx_hash", "STRING", False),
    ("paging_token", "STRING", False),
    ("in_successful_contract_call", "BOOLEAN", False),
)


FIELDS = "map<string,variant>"


def _text(item: Column, name: str) -> Column:
    return F.try_element_at(item, F.lit(name)).try_cast("string")


def _kind(item: Column, name: str) -> Column:
    """JSON kind of a field, null when the field is absent."""
    return F.schema_of_variant(F.try_element_at(item, F.lit(name)))


def _kind_ok(item: Column, name: str, kind: str, nullable: bool) -> Column:
    """Absent, or of the declared kind: a wrongly typed field spoils its line."""
    allowed = [kind, "VOID"] if nullable else [kind]
    return F.coalesce(_kind(item, name).isin(allowed), F.lit(True))


def _topics(item: Column) -> Column:
    return F.try_element_at(item, F.lit("topic")).try_cast("array<string>")


def _topics_ok(item: Column) -> Column:
    """Absent, or an array of strings only."""
    listed = _kind(item, "topic").isin("ARRAY<STRING>", "ARRAY<VOID>")
    whole = F.forall(_topics(item), lambda t: t.isNotNull())
    return F.coalesce(listed, F.lit(True)) & F.coalesce(whole, F.lit(True))


def _event_ok(item: Column) -> Column:
    ok = item.isNotNull() & _topics_ok(item)
    for name, kind, nullable in EVENT_FIELDS:
        ok = ok & _kind_ok(item, name, kind, nullable)
    return ok


def _id(item: Column) -> Column:
    return F.coalesce(_text(item, "event_id"), _text(item, "id"))


def _classify(lines: DataFrame) -> DataFrame:
    """One row per kept line: its event items as field maps and a reject reason."""
    line = stripped(F.col("value"))
    kept = lines.select(line.alias("line")).where((F.length("line") > 0) & ~F.col("line").startswith("#"))
    doc, listed = F.col("doc"), F.col("listed")
    parsed = computed_once(kept, "line", json=F.try_parse_json("line"))
    # Each object is opened once into a map of its fields; not an object -> null.
    opened = computed_once(parsed, "line", broken=F.col("json").isNull(), doc=F.col("json").try_cast(FIELDS))
    with_list = opened.withColumn("listed", F.try_element_at("doc", F.lit("events")))
    # A null list is an empty one; any other non-array is a wrong type.
    items = (
        F.when(listed.isNull(), F.array(doc))
        .when(F.is_variant_null(listed), F.array().cast(f"array<{FIELDS}>"))
        .otherwise(F.transform(listed.try_cast("array<variant>"), lambda i: i.try_cast(FIELDS)))
    )
    shaped = computed_once(with_list, "line", "broken", "doc", enveloped=listed.isNotNull(), items=items)
    enveloped = F.col("enveloped")
    time_name = F.when(enveloped, F.lit("ledger_close_time")).otherwise(F.lit("ledger_closed_at"))
    closed = F.try_element_at(doc, time_name)
    reason = (
        F.when(F.col("broken"), "invalid JSON")
        .when(doc.isNull(), "not an object")
        .when(F.col("items").isNull(), "events is not a list")
        .when(~F.coalesce(_kind(doc, "ledger") == "BIGINT", F.lit(False)), "ledger missing or not an integer")
        .when(~F.coalesce(F.schema_of_variant(closed).isin("STRING", "VOID"), F.lit(True)), "close time is not text")
        .when(~F.forall("items", _event_ok), "event field of a wrong type")
        .when(~enveloped & _id(doc).isNull(), "id missing")
        .when(~enveloped & _text(doc, "contract_id").isNull(), "contract_id missing")
    )
    ledger = F.try_element_at(doc, F.lit("ledger")).try_cast("bigint")
    return shaped.select("line", "items", ledger.alias("ledger"), closed.try_cast("string").alias("closed_text"), reason.alias("reason"))


def archive_rows(lines: DataFrame, from_ledger: int, to_ledger: int | None = None, contract_ids: Sequence[str] = ()) -> DataFrame:
    """Events and rejects in one frame, each line parsed once: event columns, or ``line`` and ``reason``."""
    classified = _classify(lines)
    bad = F.col("reason").isNotNull()
    # A bad line is one row without an item.
    items = F.when(bad, F.array(F.lit(None).cast(FIELDS))).otherwise(F.col("items"))
    exploded = classified.select("ledger", "closed_text", F.when(bad, F.col("line")).alias("line"), "reason", F.explode(items).alias("item"))
    item = F.col("item")
    rows = exploded.select(
        _id(item).alias("event_id"),
        _text(item, "contract_id").alias("contract_id"),
        "ledger",
        F.col("closed_text").alias("ledger_closed_at"),
        F.coalesce(_text(item, "type"), F.lit("contract")).alias("event_type"),
        F.coalesce(_topics(item), F.array().cast("array<string>")).alias("topics"),
        F.coalesce(_text(item, "value"), F.lit("")).alias("value"),
        F.coalesce(_text(item, "tx_hash"), F.lit("")).alias("tx_hash"),
        F.coalesce(F.try_element_at(item, F.lit("in_successful_contract_call")).try_cast("boolean"), F.lit(True)).alias(
            "in_successful_call"
        ),
        F.coalesce(F.nullif(_text(item, "paging_token"), F.lit("")), _id(item)).alias("paging_token"),
        "line",
        "reason",
    )
    wanted = F.col("event_id").isNotNull() & F.col("contract_id").isNotNull() & (F.col("ledger") >= from_ledger)
    if to_ledger is not None:
        wanted = wanted & (F.col("ledger") <= to_ledger)
    if contract_ids:
        wanted = wanted & F.col("contract_id").isin(list(contract_ids))
    return rows.where(F.col("reason").isNotNull() | wanted)


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of ``archive_rows``."""
    return rows.where("reason is null").drop("line", "reason"), rows.where("reason is not null").select("line", "reason")


def parse_archive(
    lines: DataFrame,
    from_ledger: int,
    to_ledger: int | None = None,
    contract_ids: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a DataFrame with one text column ``value``.

    Envelope entries without id or contract are dropped one by one; a bad flat
    record or envelope becomes one reject row (line, reason). Both are lazy:
    who uses both parses twice, unless through ``load_archive``.
    """
    return split_rows(archive_rows(lines, from_ledger, to_ledger, contract_ids))


def load_archive(lines: DataFrame, path: str, from_ledger: int = 0, to_ledger: int | None = None, contract_ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The same, parsed once into a table with a folder for either."""
    rows = archive_rows(lines, from_ledger, to_ledger, contract_ids).withColumn("rejected", F.col("reason").isNotNull())
    rows.write.mode("overwrite").partitionBy("rejected").parquet(path)
    kept = lines.sparkSession.read.schema(rows.schema).parquet(path)
    events = kept.where(~F.col("rejected")).drop("rejected", "line", "reason")
    return events, kept.where("rejected").select("line", "reason")


def read_archive(
    spark: SparkSession,
    paths: str | Iterable[str],
    from_ledger: int,
    to_ledger: int | None = None,
    contract_ids: Sequence[str] = (),
    spread: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scan of archive files, plain or compressed.

    Plain files are split between tasks; a gzip file is read by one task, so
    pass ``spread`` to deal its lines to that many tasks before they are parsed.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths)
    return parse_archive(lines.repartition(spread) if spread else lines, from_ledger, to_ledger, contract_ids)
