"""Event-time operators over a stream of decoded events, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators import matching
from eventloom.operators.aggregates import BUCKET_TEXT, contract_summaries
from eventloom.operators.deliveries import pending
from eventloom.operators.reads import event_json, matching as equal
from eventloom.streaming import tables

NOW_ONCE = {"availableNow": True}
# How long an item that was fanned out is remembered: as long as nodes can be asked for it again.
KEPT_FOR = "7 days"


def dedup_stream(ev: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of an id that arrive within the lateness bound.

    Keeps ids for that long only; the store's anti join covers older repeats.
    """
    return ev.withWatermark("ledger_closed_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def summaries_stream(ev: DataFrame) -> DataFrame:
    """Running per-contract summary, for update mode."""
    return contract_summaries(ev)


def stats_stream(ev: DataFrame, bucket: str = "1 hour", lateness: str = "1 hour", by_name: bool = False) -> DataFrame:
    """Tumbling counts. Update mode shows open windows, append mode closed ones."""
    keys: list[Column] = [F.window("ledger_closed_at", bucket).alias("w")]
    if by_name:
        keys.append(F.col("event_name"))
    counted = ev.withWatermark("ledger_closed_at", lateness).groupBy(*keys).agg(F.count("*").alias("count"))
    names = ["event_name"] if by_name else []
    return counted.select(F.date_format("w.start", BUCKET_TEXT).alias("bucket"), *names, "count")


def tail_stream(ev: DataFrame, contract_id: str | None = None, event_name: str | None = None) -> DataFrame:
    """A contract's events as payloads, to be sorted per batch by the sink."""
    return equal(ev, contract_id=contract_id, event_name=event_name).select("ledger", "event_id", event_json().alias("payload"))


def start_updates(df: DataFrame, out: str, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Update-mode sink: each batch writes the rows that changed in it; ``tables.compact_updates`` sums them up."""

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.put(batch, out, table, batch_id)

    query = df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or NOW_ONCE)).start()


def start_tail(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Payloads in (ledger, id) order within each batch's files.

    A range exchange orders the batch over all its files, so a busy contract
    is not sorted in one task.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.put(batch.orderBy("ledger", "event_id"), out, "tail", batch_id)

    return df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW_ONCE)).start()


def first_seen(stream: DataFrame, keys: list[str], kept_for: str = KEPT_FOR) -> DataFrame:
    """Each key once: rows whose key arrived before, within ``kept_for`` of arrival, are dropped.

    The bound is on arrival, not on the rows' own time, so old rows are never
    late and none is lost. Keys live in the state store for that long.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", kept_for)
    return arrived.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def start_fanout(events: DataFrame, upgrades: DataFrame, subscriptions: Callable[[], DataFrame], out: str, checkpoint: str,
                 now: Callable[[], Column] = F.current_timestamp, trigger: dict | None = None, kept_for: str = KEPT_FOR) -> tuple[StreamingQuery, StreamingQuery]:
    """Two independent fan-outs with their own positions.

    An item passes once (``first_seen``), so each (subscription, item) is queued
    once without a look at what was queued before: a batch costs what it
    brings, however long the history. ``subscriptions`` is read anew for every
    batch, so a subscription sees only items that arrive once it exists.
    """

    def start(name: str, stream: DataFrame, key: str, match) -> StreamingQuery:
        def store(batch: DataFrame, batch_id: int) -> None:
            made = pending(match(batch, subscriptions()).distinct(), now())
            tables.put(made, f"{out}/{name}", "deliveries", batch_id)

        query = first_seen(stream, [key], kept_for).writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/{name}")
        return query.trigger(**(trigger or NOW_ONCE)).start()

    return (
        start("events", events, "event_id", matching.match_events),
        start("upgrades", upgrades, "id", matching.match_upgrades),
    )
