"""Streams run to the end of their input, compared with their batch results."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.plans import mapping as M
from eventloom.plans.catalog import query, stamped
from eventloom.plans.catalog.decoding import BODY, ENRICHED, TOPICS, WIRE, _interfaces
from eventloom.plans.catalog.delivery import MATCHES, UPGRADES, now
from eventloom.plans.catalog.reading import _EVENT_OUT, _SUMMARY, PLACE, _event_cols, _upsert_parts
from eventloom.plans.oracle import EVENT_JSON, stamp, with_views
from eventloom.schemas import QUEUED, TAIL
from eventloom.session import shared_dir, shuffles_dropped
from eventloom.streaming import ingest, live, tables


def stream(spark, sf, name):
    """A driver table as a file stream."""
    schema = M.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def event_stream(spark, sf):
    return M.events_from(stream(spark, sf, "events"))


# Pages per landed file at most, as a packed file is one split, and files at least.
FILE_PAGES, FILES = 25_000, 4


def _land(spark, e, path, times=1):
    """Pages of events written by Spark, each so many times; returns the number of files, which grows with the events.

    The events are spread before they become pages: a small table is one split.
    Pages are packed, those of a user next to each other, as one account's text
    is a good part of a page.
    """
    files = max(FILES, math.ceil(times * e.count() / FILE_PAGES))
    spread = e.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).repartition(files).drop("_copy")
    with shuffles_dropped(spark):
        M.page_lines_from(spread.sortWithinPartitions("user_id")).write.mode("append").option("compression", "gzip").text(path)
    return files


def _landed(spark, sf, path, times=1):
    return _land(spark, M.table(spark, sf, "events"), path, times)


def _ingested(spark, sf, times=2, interfaces=None):
    """Pages, each twice unless told otherwise, followed over two micro-batches."""
    base = shared_dir(spark, "ingest")
    files = _landed(spark, sf, f"{base}/pages", times)
    ingest.start_ingest(spark, f"{base}/pages", f"{base}/out", f"{base}/checkpoint", interfaces, max_files=math.ceil(files / 2)).awaitTermination()
    return f"{base}/out"


@query("st_ingest", with_views(f"SELECT event_id, contract_id, ledger, event_name, {TOPICS} AS decoded_topics, {BODY} AS decoded_value, {stamp('ts')} AS ledger_closed_at FROM wired", WIRE))
def _st_ingest(spark, sf):
    rows = ingest.committed_events(spark, _ingested(spark, sf))
    shown = rows.select(
        "event_id", "contract_id", "ledger", "event_name",
        F.concat(F.lit("["), F.array_join("decoded_topics", ","), F.lit("]")).alias("decoded_topics"), "decoded_value", "ledger_closed_at",
    )
    return stamped(shown, "ledger_closed_at")


@query("st_ingest_summaries", with_views("SELECT contract_id, count(*) AS event_count, min(ledger) AS first_seen_ledger, max(ledger) AS last_seen_ledger FROM wired GROUP BY 1", WIRE))
def _st_ingest_summaries(spark, sf):
    return ingest.committed_summaries(spark, _ingested(spark, sf))


@query("st_ingest_enriched", with_views(f"SELECT event_id, {ENRICHED} AS enriched FROM wired", WIRE))
def _st_ingest_enriched(spark, sf):
    return ingest.committed_events(spark, _ingested(spark, sf, 1, _interfaces(spark, sf))).select("event_id", "enriched")


# Re-reading over several cycles: change, repeat, change some of it back.
WINDOW = 60_000
_AGAIN = f"""(SELECT * REPLACE (CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 AND floor(epoch(ts) / 5) >=
  (SELECT max(floor(epoch(ts) / 5)) FROM events WHERE event_id % 3 = 0) - {WINDOW} THEN value + 1 ELSE value END AS value) FROM events) e"""


@query("st_reorg_cycles", with_views(f"SELECT event_id, {BODY} AS decoded_value FROM wired", WIRE.replace("FROM events e", f"FROM {_AGAIN}")))
def _st_reorg_cycles(spark, sf):
    base = shared_dir(spark, "reorg")
    e = M.table(spark, sf, "events")
    changed = e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    for k, part in enumerate((e, changed, changed, e.where("event_id % 6 = 0"))):
        _land(spark, part, f"{base}/pages")
        # One batch per cycle; the store is compacted before the third.
        out = f"{base}/out{k // 2}"
        if k == 2:
            ingest.compact(spark, f"{base}/out0", out)
        ingest.start_ingest(spark, f"{base}/pages", out, f"{base}/checkpoint", reorg_ledgers=WINDOW).awaitTermination()
    return ingest.committed_events(spark, out).select("event_id", "decoded_value")


@query("st_dedup", with_views(f"SELECT {_EVENT_OUT} FROM ev"))
def _st_dedup(spark, sf):
    base = shared_dir(spark, "dedup")
    ev = event_stream(spark, sf)
    unique = _event_cols(live.dedup_stream(ev.unionAll(ev)))
    q = unique.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


TIP, OVERLAP = PLACE[0] + 50_000, 120_000


@query(
    "st_reorg",
    with_views(
        f"""SELECT event_id, contract_id, ledger, event_name, CASE WHEN NOT in_successful_call AND ledger BETWEEN {max(TIP - OVERLAP, PLACE[0] - 100_000)} AND {TIP} THEN 'changed' ELSE amount END AS amount,
  tx_hash FROM ev WHERE ledger < {PLACE[0]} OR ledger BETWEEN {TIP - OVERLAP} AND {TIP}"""
    ),
)
def _st_reorg(spark, sf):
    old, new = _upsert_parts(spark, sf)
    return _event_cols(ingest.reorg_batch(old, new, TIP, OVERLAP)[0])


@query("st_match", with_views("SELECT subscription_id, event_id, NULL AS upgrade_id FROM m UNION ALL SELECT subscription_id, NULL, upgrade_id FROM u", f"m AS ({MATCHES}), u AS ({UPGRADES})"))
def _st_match(spark, sf):
    base = shared_dir(spark, "fanout")
    M.upgrade_rows(spark, sf).write.parquet(f"{base}/versions")
    upgrades = spark.readStream.schema(M.upgrade_rows(spark, sf).schema).parquet(f"{base}/versions")
    queries = live.start_fanout(
        event_stream(spark, sf), upgrades, lambda: M.subscriptions(spark, sf), f"{base}/out", f"{base}/checkpoint", now=now
    )
    for q in queries:
        q.awaitTermination()
    parts = [tables.stored(spark, f"{base}/out/{n}", "deliveries", QUEUED) for n in ("events", "upgrades")]
    return parts[0].unionByName(parts[1]).select("subscription_id", "event_id", "upgrade_id")


def _updates(spark, df, name, keys):
    base = shared_dir(spark, name)
    live.start_updates(df, f"{base}/out", name, f"{base}/checkpoint").awaitTermination()
    return tables.newest_per_key(tables.stored(spark, f"{base}/out", name, df.schema), keys)


@query("st_summaries", with_views(f"SELECT {_SUMMARY} FROM ev GROUP BY contract_id"))
def _st_summaries(spark, sf):
    return _updates(spark, live.summaries_stream(event_stream(spark, sf)), "summaries", ["contract_id"])


@query(
    "st_stats",
    with_views("SELECT strftime(date_trunc('hour', ledger_closed_at), '%Y-%m-%d %H:%M:%S+00') AS bucket, event_name, count(*) AS count FROM ev GROUP BY 1, 2"),
)
def _st_stats(spark, sf):
    return _updates(spark, live.stats_stream(event_stream(spark, sf), "1 hour", by_name=True), "stats", ["bucket", "event_name"])


@query("st_tail", with_views(f"SELECT ledger, event_id, {EVENT_JSON} AS payload FROM ev WHERE contract_id = 'C003' AND event_name = 'mint'"))
def _st_tail(spark, sf):
    base = shared_dir(spark, "tail")
    live.start_tail(live.tail_stream(event_stream(spark, sf), "C003", "mint"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return tables.stored(spark, f"{base}/out", "tail", TAIL).drop("batch")
