"""Lookups over stored tables: by id, transaction, address, topic and parameter."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import reads, verticals
from eventloom.plans import mapping as M
from eventloom.plans.catalog import query
from eventloom.plans.catalog.reading import _EVENT_OUT, TRANSFER_COLS, _event_cols, cols
from eventloom.plans.oracle import with_views
from eventloom.session import shared_dir
from eventloom.sources import postings, store

# The events under ids that encode their ledger.
ENCODED = "enc AS (SELECT * REPLACE (lpad(CAST((ledger << 32) + n AS VARCHAR), 19, '0') || '-0000000000' AS event_id) FROM ev)"
_MOVES = f"""{ENCODED}, moves AS (SELECT event_id, contract_id, CASE WHEN event_name <> 'mint' THEN topic1 END AS from_addr,
  CASE event_name WHEN 'transfer' THEN topic2 WHEN 'mint' THEN topic1 END AS to_addr, amount, event_name AS kind, ledger FROM enc WHERE event_name IS NOT NULL)"""
TRANSACTIONS = [f"tx{k * 37}" for k in range(25)] + ["tx-none"]
ADDRESSES = ["G13", "G77"]


def _stored(spark, sf):
    path = shared_dir(spark, "stored")
    events = M.encoded_events(spark, sf)
    store.write_events(events, f"{path}/events")
    store.write_derived(verticals.token_transfers(events), f"{path}/transfers", "token_transfers")
    return path


@query("q_event_stored", with_views(f"SELECT {_EVENT_OUT} FROM enc WHERE event_id = (SELECT max(event_id) FROM enc WHERE event_name = 'mint')", ENCODED))
def _event_stored(spark, sf):
    path = _stored(spark, sf)
    wanted = spark.read.parquet(f"{path}/events").where("event_name = 'mint'").agg(F.max("event_id")).first()[0]
    return _event_cols(store.find_event(spark, f"{path}/events", wanted))


@query("q_events_by_id", with_views(f"SELECT {_EVENT_OUT} FROM enc WHERE event_id IN (SELECT event_id FROM moves WHERE to_addr IN ('{ADDRESSES[0]}', '{ADDRESSES[1]}') AND kind = 'mint')", _MOVES))
def _events_by_id(spark, sf):
    """The events behind an address's incoming mints."""
    path = _stored(spark, sf)
    ids = store.find_values(spark, f"{path}/transfers", "to_addr", ADDRESSES).where("kind = 'mint'")
    return _event_cols(store.find_events(spark, f"{path}/events", ids))


@query("q_tx_stored", with_views(f"SELECT {_EVENT_OUT} FROM enc WHERE tx_hash IN ({', '.join(map(repr, TRANSACTIONS))})", ENCODED))
def _tx_stored(spark, sf):
    return _event_cols(store.find_values(spark, f"{_stored(spark, sf)}/events", "tx_hash", TRANSACTIONS))


@query("q_transfers_stored", with_views(f"SELECT {TRANSFER_COLS} FROM moves WHERE from_addr = 'G13' ORDER BY ledger DESC, event_id DESC LIMIT 1000", _MOVES))
def _transfers_stored(spark, sf):
    found = store.find_values(spark, f"{_stored(spark, sf)}/transfers", "from_addr", ["G13"])
    return reads.list_transfers(found, from_="G13", limit=1000).select(*cols(TRANSFER_COLS))


_SEARCH = "contract_id = 'C003' AND event_name = 'transfer'"


@query("q_events_indexed", with_views(f"SELECT {_EVENT_OUT} FROM enc WHERE {_SEARCH} ORDER BY ledger DESC, event_id DESC LIMIT 1000", ENCODED))
def _events_indexed(spark, sf):
    path = _stored(spark, sf)
    postings.write_postings(postings.postings(spark.read.parquet(f"{path}/events")), f"{path}/postings")
    found = postings.list_events(spark, f"{path}/events", f"{path}/postings", "C003", limit=1000, event_name="transfer", topics={0: "transfer"})
    return _event_cols(found)


@query("q_param_indexed", with_views(f"SELECT {_EVENT_OUT} FROM enc WHERE contract_id = 'C007' AND has_enriched AND k = '7' ORDER BY ledger DESC, event_id DESC LIMIT 1000", ENCODED))
def _param_indexed(spark, sf):
    path = _stored(spark, sf)
    # Two halves of the events, indexed apart and merged.
    events = spark.read.parquet(f"{path}/events")
    odd = F.crc32(F.encode("event_id", "UTF-8")) % 2 == 1
    postings.write_postings(postings.merged(postings.postings(events.where(odd)), postings.postings(events.where(~odd))), f"{path}/postings")
    return _event_cols(postings.list_events(spark, f"{path}/events", f"{path}/postings", "C007", limit=1000, param=("k", "7")))


@query(
    "idx_terms",
    with_views(
        """SELECT contract_id, kind, value, CAST(count(DISTINCT ledger // 17280) AS BIGINT) AS folders FROM (
  SELECT contract_id, ledger, 'name' AS kind, event_name AS value FROM ev UNION ALL SELECT contract_id, ledger, 'topic0', event_name FROM ev
  UNION ALL SELECT contract_id, ledger, 'topic1', topic1 FROM ev UNION ALL SELECT contract_id, ledger, 'topic2', topic2 FROM ev
  UNION ALL SELECT contract_id, ledger, 'param:k', k FROM ev WHERE has_enriched) WHERE value IS NOT NULL GROUP BY 1, 2, 3"""
    ),
)
def _idx_terms(spark, sf):
    """Folders per term, counted on the bitmaps."""
    ev = M.ev(spark, sf)
    named = postings.terms(ev).select("contract_id", "kind", "value").distinct()
    counted = postings.postings(ev).groupBy("term").agg(F.sum(F.bitmap_count("folders")).alias("folders"))
    term = F.xxhash64("contract_id", "kind", "value")
    return named.withColumn("term", term).join(counted, "term").select("contract_id", "kind", "value", "folders")
