"""Live tail: landed pages -> new events -> derived tables, exactly once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators import merge, verticals
from eventloom.operators.aggregates import contract_summaries
from eventloom.operators.convert import to_events
from eventloom.schemas import EVENT_COLUMNS, EVENTS, SUMMARIES
from eventloom.session import shuffles_dropped
from eventloom.sources.pages import parse_pages
from eventloom.sources.store import LEDGERS_PER_BUCKET, clustered, with_bucket
from eventloom.streaming import tables

VERTICALS = {
    "token_transfers": verticals.token_transfers,
    "amm_swaps": verticals.amm_swaps,
    "nft_events": verticals.nft_events,
    "liquidity_events": verticals.liquidity_events,
}
STORED = T.StructType([*EVENTS.fields, T.StructField("ledger_bucket", T.LongType())])
# One row per finished batch, written last: what readers take as the end of the tables.
CYCLES = "cycles"
CYCLE = T.StructType([
    T.StructField("last_ledger", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("errors", T.LongType()), T.StructField("ingested", T.LongType()),
])
# Ledger folders a batch may name one by one; a batch over more reads from the first to the last.
NAMED_BUCKETS = 500
# Whole rows that are shuffled at once, so that disk for shuffles and spills does not grow with the batch; slices at most,
# as each reads the batch again.
SLICE_ROWS, SLICES = 4_000_000, 16


def _slices(rows: int) -> list[Column]:
    """Conditions that cut so many rows by id: each row is in one slice, with all copies of its id."""
    n = min(SLICES, math.ceil(rows / SLICE_ROWS))
    return [F.pmod(F.xxhash64("event_id"), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]


def _overlaid(base: DataFrame, revisions: DataFrame) -> DataFrame:
    """Stored rows with the newest revision of their content; as they are when there is no revision."""
    if revisions.isEmpty():
        return base
    newest = tables.newest_per_key(revisions.select("event_id", *merge.REFRESHED, "batch"), ["event_id"])
    renamed = newest.select("event_id", F.struct(*merge.REFRESHED).alias("_new"))
    joined = base.join(renamed, "event_id", "left")
    return joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in merge.REFRESHED else F.col(c)
        for c in base.columns
    ])


def next_batch(spark: SparkSession, out: str) -> int:
    """One more than the last finished batch: the log of cycles is written after a batch's tables."""
    last = tables.stored(spark, out, CYCLES, CYCLE).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def committed_events(spark: SparkSession, out: str, from_ledger: int | None = None, to_ledger: int | None = None) -> DataFrame:
    """Events of finished batches with their newest re-scanned content; other ledgers' folders are not read."""
    return _between(spark, out, next_batch(spark, out), from_ledger, to_ledger).select(*EVENT_COLUMNS)


def _between(spark: SparkSession, out: str, before: int, low: int | None, high: int | None, events: DataFrame | None = None,
             part: Column | None = None) -> DataFrame:
    """Events of batches before one, with their revisions; ``events`` if the caller has listed them already, one slice with ``part``."""
    where = F.lit(True) if part is None else part
    if low is not None:
        where = where & (F.col("ledger_bucket") >= low // LEDGERS_PER_BUCKET) & (F.col("ledger") >= low)
    if high is not None:
        where = where & (F.col("ledger_bucket") <= high // LEDGERS_PER_BUCKET) & (F.col("ledger") <= high)
    events = tables.stored(spark, out, "events", STORED, before) if events is None else events
    return _overlaid(events.where(where), tables.stored(spark, out, "revisions", STORED, before).where(where))


def committed_rows(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of one of the derived tables (``VERTICALS``)."""
    schema = VERTICALS[table](spark.createDataFrame([], EVENTS)).schema
    return tables.stored(spark, out, table, _foldered(schema), next_batch(spark, out)).select(*schema.names)


def _foldered(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("ledger_bucket", T.LongType())])


def committed_summaries(spark: SparkSession, out: str) -> DataFrame:
    """Running summaries: the per-batch partial rows folded together."""
    parts = tables.stored(spark, out, "contract_summaries", SUMMARIES, next_batch(spark, out))
    return parts.groupBy("contract_id").agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_seen_ledger").alias("first_seen_ledger"),
        F.max("last_seen_ledger").alias("last_seen_ledger"),
    )


def ingest_batch(raw: DataFrame, batch_id: int, out: str, interfaces: DataFrame | None = None, reorg_ledgers: int = 0,
                 ids_pin_ledger: bool = True) -> None:
    """Store one micro-batch of raw events and everything derived from it.

    An event id encodes its ledger, so with ``ids_pin_ledger`` the store is
    read only in the ledger folders the batch touches. With ``reorg_ledgers``,
    re-read events of the last ledgers become revisions where their content
    differs from what the store shows for them. A large batch is sorted out
    and written in slices by id.
    """
    with shuffles_dropped(raw.sparkSession):
        _ingest_batch(raw, batch_id, out, interfaces, reorg_ledgers, ids_pin_ledger)


def _ingest_batch(raw: DataFrame, batch_id: int, out: str, interfaces: DataFrame | None, reorg_ledgers: int, ids_pin_ledger: bool) -> None:
    spark = raw.sparkSession
    # The batch is decoded once: staged, then read back by every step, and emptied after the last.
    decoded = to_events(raw, interfaces)
    tables.packed(decoded).mode("overwrite").parquet(f"{out}/staging")
    incoming = spark.read.schema(decoded.schema).parquet(f"{out}/staging")
    rows = with_bucket(incoming.select(*EVENT_COLUMNS))
    span = rows.agg(
        F.min("ledger").alias("low"), F.max("ledger").alias("high"), F.slice(F.collect_set("ledger_bucket"), 1, NAMED_BUCKETS + 1).alias("buckets"),
        F.count("*").alias("rows"),
    ).first()
    # Listed once: the anti join and the comparison below read the same files.
    known = before = tables.stored(spark, out, "events", STORED, before=batch_id)
    if ids_pin_ledger and span["low"] is not None:
        few = len(span["buckets"]) <= NAMED_BUCKETS
        touched = F.col("ledger_bucket").isin(span["buckets"]) if few else F.col("ledger_bucket").between(span["low"] // LEDGERS_PER_BUCKET, span["high"] // LEDGERS_PER_BUCKET)
        known = known.where(touched)
    parts, read_again = _slices(span["rows"]), []
    for k, part in enumerate(parts):
        stored, some = known.where(part), incoming.where(part)
        repeated, seen = merge.id_marks(stored, some)
        read_again.append(seen)
        new = merge.insert_new(stored, some.select(*EVENT_COLUMNS), repeated=repeated, seen=seen)
        tables.put(clustered(new), out, "events", batch_id, by=["ledger_bucket"], more=k > 0)
    own = spark.read.schema(STORED).parquet(f"{out}/events/batch={batch_id}")
    for name, project in VERTICALS.items():
        tables.put(with_bucket(project(own.select(*EVENT_COLUMNS))), out, name, batch_id, by=["ledger_bucket"])
    tables.put(contract_summaries(own), out, "contract_summaries", batch_id)
    if reorg_ledgers > 0:
        first = (span["high"] or 0) - reorg_ledgers
        for k, part in enumerate(parts):
            # Without a stored id nothing can have changed; no rows are shuffled to find that out.
            part = part if read_again[k] else F.lit(False)
            shown = _between(spark, out, batch_id, first, None, before, part)
            if span["buckets"] and len(span["buckets"]) <= NAMED_BUCKETS:
                shown = shown.where(F.col("ledger_bucket").isin(span["buckets"]))
            changed = changed_content(shown, rows.where((F.col("ledger") >= first) & part))
            tables.put(with_bucket(changed.select(*EVENT_COLUMNS)), out, "revisions", batch_id, by=["ledger_bucket"], more=k > 0)
    log = incoming.agg(F.max("ledger").alias("last_ledger"), F.max("ledger_closed_at").alias("at"), F.count_if("bad_close_time").alias("errors"))
    tables.put(log.withColumn("ingested", F.lit(own.count()).cast("bigint")), out, CYCLES, batch_id)
    spark.createDataFrame([], decoded.schema).write.mode("overwrite").parquet(f"{out}/staging")


def compact(spark: SparkSession, out: str, target: str, first_ledger: int | None = None) -> None:
    """Write the finished batches of a store as one batch of a new one: revisions into their events, one summary row per contract.

    A plain batch job for between two runs of the stream, which then goes on
    from ``target`` with the same checkpoint. Rows before ``first_ledger`` are
    left behind, with whole folders not read at all. A large store is written
    in slices by id.
    """
    with shuffles_dropped(spark):
        _compact(spark, out, target, first_ledger)


def _compact(spark: SparkSession, out: str, target: str, first_ledger: int | None) -> None:
    last = next_batch(spark, out) - 1
    if last < 0:
        return
    events = tables.stored(spark, out, "events", STORED, last + 1)
    for k, part in enumerate(_slices(events.count())):
        shown = _between(spark, out, last + 1, first_ledger, None, events, part)
        tables.put(clustered(shown.select(*EVENT_COLUMNS)), target, "events", last, by=["ledger_bucket"], more=k > 0)
    for name, project in VERTICALS.items():
        rows = tables.stored(spark, out, name, _foldered(project(spark.createDataFrame([], EVENTS)).schema), last + 1).drop("batch")
        if first_ledger is not None:
            rows = rows.where((F.col("ledger_bucket") >= first_ledger // LEDGERS_PER_BUCKET) & (F.col("ledger") >= first_ledger))
        for k, part in enumerate(_slices(rows.count())):
            tables.put(clustered(rows.where(part).drop("ledger_bucket")), target, name, last, by=["ledger_bucket"], more=k > 0)
    # Summaries are lifetime counts: they outlive pruned events.
    tables.put(committed_summaries(spark, out), target, "contract_summaries", last)
    cycles = tables.stored(spark, out, CYCLES, CYCLE, last + 1)
    totals = cycles.agg(F.max("last_ledger").alias("last_ledger"), F.max("at").alias("at"), F.sum("errors").alias("errors"), F.sum("ingested").alias("ingested"))
    tables.put(totals, target, CYCLES, last)


def changed_content(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows of stored ids whose decoded content differs."""
    old = known.select("event_id", F.struct(*merge.REFRESHED).alias("_old"))
    joined = merge.first_copies(incoming).join(old, "event_id")  # only ids the store shows
    same = F.lit(True)
    for name in merge.REFRESHED:
        same = same & F.col(name).eqNullSafe(F.col(f"_old.{name}"))
    return joined.where(~same).drop("_old")


def start_ingest(spark: SparkSession, pages_dir: str, out: str, checkpoint: str, interfaces: DataFrame | None = None,
                 contract_ids: Sequence[str] = (), reorg_ledgers: int = 0, max_files: int | None = None,
                 trigger: dict | None = None, ids_pin_ledger: bool = True) -> StreamingQuery:
    """Follow a folder of landed pages. The checkpoint is the ledger cursor."""
    reader = spark.readStream.format("text").schema("value string")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    raw = parse_pages(reader.load(pages_dir), contract_ids)

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, out, interfaces, reorg_ledgers, ids_pin_ledger)

    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reorg_batch(stored: DataFrame, incoming: DataFrame, tip: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(events, stats) after re-reading the last ``overlap`` ledgers.

    Rows past the tip are left to the next cycle; rows before the window are
    not touched and take no part in the join.
    """
    first = tip - overlap
    window = F.col("ledger").between(first, tip)
    merged, stats = merge.upsert_events(stored.where(F.col("ledger") >= first), incoming.where(window))
    return stored.where(F.col("ledger") < first).unionByName(merged), stats
