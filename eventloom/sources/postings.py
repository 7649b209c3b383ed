"""Inverted index from topic and parameter values to ledger folders.

A term is a contract with an event name, a topic text at a position, or a value
of a named enriched parameter; its posting is a bitmap of the ledger folders
that hold such an event. A search intersects the postings of its terms and
reads only the folders that are left; the filters themselves still run on the
rows, so the index decides what is read, never what is found.

Terms are stored as 64-bit hashes, sorted, so a lookup reads the few row groups
its hashes fall into; equal hashes of different terms only add folders. A bitmap
covers ``CHUNK`` folders and is stored without the engine's padding to 4 KB. What
is shuffled and sorted are distinct (term, folder) numbers, combined map-side, and
bitmaps are made last, one at a time. Postings of new events are merged alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import topic_text
from eventloom.operators import reads
from eventloom.sources.store import LEDGERS_PER_BUCKET, bucket_of, read_events

TOPICS = 4
# Folders per bitmap. The engine's bitmap functions hold 32,768 bits and always fill them up.
CHUNK = 512


def _term(contract_id, kind, value) -> Column:
    """Hash of a term; columns or plain texts."""
    return F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in (contract_id, kind, value)])


def _param_values(enriched: Column) -> Column:
    """(name, text) of the enriched record's parameters, as the parameter filter compares them."""
    record = F.try_variant_get(F.try_parse_json(enriched), "$.params", "map<string,variant>")
    entries = F.coalesce(F.map_entries(record), F.array().cast("array<struct<key:string,value:variant>>"))
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit("param:"), e["key"]).alias("kind"), F.try_variant_get(e["value"], "$.value", "string").alias("value")))


def terms(ev: DataFrame, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """(contract_id, kind, value, folder): the terms of every event, with repeats."""
    fixed = [F.struct(F.lit("name").alias("kind"), F.col("event_name").alias("value"))]
    fixed += [F.struct(F.lit(f"topic{k}").alias("kind"), topic_text(F.col("decoded_topics"), k).alias("value")) for k in range(TOPICS)]
    every = F.concat(F.array(*fixed), _param_values(F.col("enriched")))
    rows = ev.select("contract_id", bucket_of(F.col("ledger"), width).alias("folder"), F.explode(every).alias("t"))
    return rows.where("t.value IS NOT NULL").select("contract_id", "t.kind", "t.value", "folder")


def postings(ev: DataFrame, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """(term, chunk, folders): folder chunk * CHUNK + bit for each bit set."""
    marked = terms(ev, width).select(
        _term(F.col("contract_id"), F.col("kind"), F.col("value")).alias("term"),
        F.floor(F.col("folder") / CHUNK).alias("chunk"), F.pmod(F.col("folder"), F.lit(CHUNK)).alias("bit"),
    )
    return _per_term(marked.distinct(), F.bitmap_construct_agg("bit"))


def _per_term(rows: DataFrame, bitmap: Column) -> DataFrame:
    """One bitmap per term and chunk, made where the rows of a term are together: the engine's 4 KB never leave the task."""
    return rows.repartition("term", "chunk").groupBy("term", "chunk").agg(_trimmed(bitmap).alias("folders"))


def _trimmed(bitmap: Column) -> Column:
    return F.substring(bitmap, 1, CHUNK // 8)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of two sets of events."""
    return _per_term(old.unionByName(new), F.bitmap_or_agg("folders"))


def write_postings(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    found.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(path)


def folders(spark: SparkSession, path: str, contract_id: str, event_name: str | None = None, topics: Mapping[int, str] | None = None,
            param: tuple[str, str] | None = None) -> list[int] | None:
    """Folders that can hold an event with all of the terms; null if there is no term to search by.

    One bitmap per ``CHUNK`` folders of the store reaches the driver.
    """
    wanted = [("name", event_name)] if event_name is not None else []
    wanted += [(f"topic{k}", text) for k, text in (topics or {}).items()]
    wanted += [(f"param:{param[0]}", param[1])] if param is not None else []
    if not wanted:
        return None
    hashes = spark.range(1).select(*[_term(contract_id, kind, text).alias(f"h{k}") for k, (kind, text) in enumerate(wanted)]).first()
    found = spark.read.parquet(path).where(F.col("term").isin(sorted(set(hashes))))
    both = found.groupBy("chunk").agg(_trimmed(F.bitmap_and_agg("folders")).alias("folders"), F.count("*").alias("n")).where(F.col("n") == len(set(hashes)))
    # Byte i of a bitmap holds bits 8 * i to 8 * i + 7.
    return sorted(
        r["chunk"] * CHUNK + 8 * i + k for r in both.collect() for i, byte in enumerate(r["folders"]) if byte for k in range(8) if byte >> k & 1
    )


def list_events(spark: SparkSession, events_path: str, postings_path: str, contract_id: str, limit: int = reads.DEFAULT_LIMIT, after: str | None = None,
                width: int = LEDGERS_PER_BUCKET, **filters) -> DataFrame:
    """``reads.list_events`` over a stored table, from the folders its terms name."""
    at = folders(spark, postings_path, contract_id, filters.get("event_name"), filters.get("topics"), filters.get("param"))
    stored = read_events(spark, events_path, filters.get("from_ledger"), filters.get("to_ledger"), width, at)
    return reads.list_events(stored, contract_id, limit, after, **filters)
