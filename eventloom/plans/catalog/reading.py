"""Projections, filters, pages, aggregates and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.cursor import cursor_text, decode_cursor, encode_cursor
from eventloom.functions.wire import event_name
from eventloom.operators import aggregates as A
from eventloom.operators import discovery, merge, reads, verticals
from eventloom.plans import mapping as M
from eventloom.plans.catalog import counted, query, stamped
from eventloom.plans.oracle import EVENT_JSON, stamp, with_views

CONTRACT = "C003"
# A newest-first position inside the driver's events.
PLACE = (341_100_000, "000000005500")

TRANSFER_COLS = "event_id, contract_id, from_addr, to_addr, amount, kind, ledger"
SWAP_COLS = "event_id, contract_id, sender, sell_token, buy_token, sell_amount, buy_amount, raw_event_name, ledger"
NFT_COLS = "event_id, contract_id, event_kind, from_addr, to_addr, token_id, ledger"
LIQ_COLS = "event_id, contract_id, event_kind, provider, amount_a, amount_b, shares, raw_event_name, extra_amounts, ledger"


def cols(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


@query("event_name", with_views("SELECT event_id, event_name FROM ev"))
def _event_name(spark, sf):
    return M.ev(spark, sf).select("event_id", event_name(F.col("decoded_topics")).alias("event_name"))


# ---- projections


@query("proj_transfers", with_views(f"SELECT {TRANSFER_COLS}, {stamp('ledger_closed_at')} AS ledger_closed_at FROM transfers"))
def _transfers(spark, sf):
    return stamped(verticals.token_transfers(M.ev(spark, sf)), "ledger_closed_at")


def swaps(spark, sf):
    return verticals.amm_swaps(M.swap_events(spark, sf), fields={"trade": ("amount_in", "amount_out")})


@query("proj_swaps", with_views(f"SELECT {SWAP_COLS} FROM swaps"))
def _swaps(spark, sf):
    return swaps(spark, sf).drop("ledger_closed_at")


@query("proj_nfts", with_views(f"SELECT {NFT_COLS} FROM nfts"))
def _nfts(spark, sf):
    return verticals.nft_events(M.nft_source(spark, sf)).drop("ledger_closed_at")


@query("proj_liquidity", with_views(f"SELECT {LIQ_COLS} FROM liquidity"))
def _liquidity(spark, sf):
    return verticals.liquidity_events(M.liquidity_source(spark, sf)).drop("ledger_closed_at")


# ---- filters, lookups, pages

_PAGE = "ORDER BY ledger DESC, event_id DESC LIMIT"
_EVENT_OUT = "event_id, contract_id, ledger, event_name, amount, tx_hash"


def _event_cols(df):
    return df.select("event_id", "contract_id", "ledger", "event_name", F.replace("decoded_value", F.lit('"'), F.lit("")).alias("amount"), "tx_hash")


@query(
    "q_events",
    with_views(
        f"SELECT {_EVENT_OUT} FROM ev WHERE contract_id = '{CONTRACT}' AND event_name = 'transfer' AND ledger BETWEEN 340900000 AND 341200000 "
        f"AND ledger_closed_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' "
        f"AND topic1 = 'G13' AND has_enriched {_PAGE} 50"
    ),
)
def _q_events(spark, sf):
    from datetime import datetime

    found = reads.list_events(
        M.ev(spark, sf), CONTRACT, event_name="transfer", from_ledger=340_900_000, to_ledger=341_200_000,
        since=datetime(2024, 1, 5), until=datetime(2024, 1, 25), topics={0: "transfer", 1: "G13"}, enriched_only=True,
    )
    return _event_cols(found)


@query("q_events_param", with_views(f"SELECT {_EVENT_OUT} FROM ev WHERE has_enriched AND k = '7'"))
def _q_events_param(spark, sf):
    return _event_cols(reads.filter_events(M.ev(spark, sf), param=("k", "7")))


@query(
    "q_page_keyset",
    with_views(
        f"SELECT {_EVENT_OUT}, to_base64(encode(ledger || '|' || event_id)) AS end_cursor, "
        "(SELECT count(*) FROM ev WHERE contract_id = 'C003' AND (ledger < 341100000 OR (ledger = 341100000 AND event_id < '000000005500'))) > 100 AS has_next "
        f"FROM ev WHERE contract_id = '{CONTRACT}' AND (ledger < {PLACE[0]} OR (ledger = {PLACE[0]} AND event_id < '{PLACE[1]}')) {_PAGE} 100"
    ),
)
def _q_page_keyset(spark, sf):
    mine = _event_cols(reads.filter_events(M.ev(spark, sf), CONTRACT))
    return reads.page_rows(mine, limit=100, after=cursor_text(*PLACE))


@query("q_page_offset", with_views(f"SELECT {_EVENT_OUT} FROM ev WHERE contract_id = '{CONTRACT}' {_PAGE} 50 OFFSET 120"))
def _q_page_offset(spark, sf):
    return _event_cols(reads.page_offset(reads.filter_events(M.ev(spark, sf), CONTRACT), 50, 120))


@query(
    "q_cursor",
    with_views("SELECT event_id, to_base64(encode(ledger || '|' || event_id)) AS cursor, ledger AS back_ledger, event_id AS back_id FROM ev"),
)
def _q_cursor(spark, sf):
    made = M.ev(spark, sf).select("event_id", encode_cursor(F.col("ledger"), F.col("event_id")).alias("cursor"))
    back = made.withColumn("c", decode_cursor(F.col("cursor")))
    return back.select("event_id", "cursor", F.col("c.ledger").alias("back_ledger"), F.col("c.event_id").alias("back_id"))


@query("q_event", with_views(f"SELECT {_EVENT_OUT} FROM ev WHERE event_id = '000000000123'"))
def _q_event(spark, sf):
    return _event_cols(reads.get_event(M.ev(spark, sf), "000000000123"))


@query("q_tx", with_views(f"SELECT {_EVENT_OUT} FROM ev WHERE tx_hash = 'tx100' ORDER BY ledger, event_id LIMIT 100"))
def _q_tx(spark, sf):
    return _event_cols(reads.transaction_events(M.ev(spark, sf), "tx100"))


@query("q_transfers", with_views(f"SELECT {TRANSFER_COLS} FROM transfers WHERE from_addr = 'G13' {_PAGE} 50"))
def _q_transfers(spark, sf):
    return reads.list_transfers(verticals.token_transfers(M.ev(spark, sf)), from_="G13").drop("ledger_closed_at")


@query("q_swaps", with_views(f"SELECT {SWAP_COLS} FROM swaps WHERE contract_id = 'C3' AND buy_token = 'S3' {_PAGE} 50"))
def _q_swaps(spark, sf):
    return reads.list_swaps(swaps(spark, sf), "C3", buy_token="S3").drop("ledger_closed_at")


@query("q_nfts", with_views(f"SELECT {NFT_COLS} FROM nfts WHERE contract_id = 'C3' AND event_kind = 'transfer' AND to_addr = 'S3' {_PAGE} 50"))
def _q_nfts(spark, sf):
    nf = verticals.nft_events(M.nft_source(spark, sf))
    return reads.list_nfts(nf, "C3", kind="transfer", to="S3").drop("ledger_closed_at")


@query("q_liquidity", with_views(f"SELECT {LIQ_COLS} FROM liquidity WHERE contract_id = 'C3' AND event_kind = 'add' {_PAGE} 50"))
def _q_liquidity(spark, sf):
    lq = verticals.liquidity_events(M.liquidity_source(spark, sf))
    return reads.list_liquidity(lq, "C3", kind="add").drop("ledger_closed_at")


_SUMMARY = "contract_id, count(*) AS event_count, min(ledger) AS first_seen_ledger, max(ledger) AS last_seen_ledger"


@query("q_contracts", with_views(f"SELECT {_SUMMARY} FROM ev GROUP BY contract_id ORDER BY event_count DESC, contract_id"))
def _q_contracts(spark, sf):
    return reads.list_contracts(A.contract_summaries(M.ev(spark, sf)))


@query("q_state", with_views("SELECT contract_id, ledger, storage FROM cstate WHERE contract_id = 'C003' ORDER BY ledger DESC LIMIT 20"))
def _q_state(spark, sf):
    return reads.contract_state(M.contract_states(spark, sf), CONTRACT, 20)


_DATA = "contract_id, key_hash, key, ledger, label, value"


@query(
    "q_data_latest",
    with_views(f"SELECT {_DATA} FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, key_hash ORDER BY ledger DESC) AS r FROM cdata) WHERE r = 1"),
)
def _q_data_latest(spark, sf):
    return reads.latest_per_key(M.contract_data(spark, sf)).drop("durability")


@query(
    "q_data_latest_label",
    with_views(
        f"SELECT {_DATA} FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY ledger DESC) AS r FROM cdata "
        "WHERE contract_id = 'C003' AND label = 'balance') WHERE r = 1 ORDER BY ledger DESC, key_hash LIMIT 100"
    ),
)
def _q_data_latest_label(spark, sf):
    return reads.contract_data_latest(M.contract_data(spark, sf), CONTRACT, "balance").drop("durability")


@query(
    "q_data_history",
    with_views(
        "SELECT contract_id, key_hash, key, durability, ledger, value, (SELECT label FROM cdata WHERE contract_id = 'C003' AND key_hash = sha256('G13') "
        "ORDER BY ledger DESC LIMIT 1) AS label FROM cdata WHERE contract_id = 'C003' AND key_hash = sha256('G13') ORDER BY ledger DESC LIMIT 25"
    ),
)
def _q_data_history(spark, sf):
    import hashlib

    return reads.contract_data_history(M.contract_data(spark, sf), CONTRACT, hashlib.sha256(b"G13").hexdigest(), 25)


@query(
    "q_tail",
    with_views(
        f"SELECT ledger, event_id, {EVENT_JSON} AS payload FROM ev WHERE contract_id = '{CONTRACT}' AND event_name = 'mint' AND "
        f"(ledger > {PLACE[0]} OR (ledger = {PLACE[0]} AND event_id > '{PLACE[1]}')) ORDER BY ledger, event_id LIMIT 100"
    ),
)
def _q_tail(spark, sf):
    return reads.events_after(M.ev(spark, sf), CONTRACT, PLACE, "mint")


# ---- aggregates


@query("agg_summaries", with_views(f"SELECT {_SUMMARY} FROM ev GROUP BY contract_id"))
def _agg_summaries(spark, sf):
    return A.contract_summaries(M.ev(spark, sf))


@query("agg_summaries_inc", with_views(f"SELECT {_SUMMARY} FROM ev GROUP BY contract_id"))
def _agg_summaries_inc(spark, sf):
    ev = M.ev(spark, sf)
    half = F.col("ledger") < PLACE[0]
    return A.merge_summaries(A.contract_summaries(ev.where(half)), ev.where(~half))


def _stats(bucket: str, text: str) -> None:
    key = "ledger" if bucket == "ledger" else f"date_trunc('{bucket}', ledger_closed_at)"

    @query(f"stats_{bucket}", with_views(f"SELECT {text} AS bucket, count(*) AS count FROM (SELECT {key} AS b FROM ev) GROUP BY b"))
    def _plain(spark, sf):
        return A.contract_stats(M.ev(spark, sf), None, bucket)

    @query(
        f"stats_{bucket}_named",
        with_views(
            f"SELECT {text} AS bucket, CAST(sum(n) AS BIGINT) AS count, CASE WHEN count(event_name) > 0 THEN '{{' || "
            "string_agg('\"' || event_name || '\":' || n, ',' ORDER BY event_name) FILTER (WHERE event_name IS NOT NULL) || '}' END AS breakdown "
            f"FROM (SELECT {key} AS b, event_name, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY b"
        ),
    )
    def _named(spark, sf):
        grouped = A.contract_stats(M.ev(spark, sf), None, bucket, group_by="event_name")
        return grouped.withColumn("breakdown", F.to_json("breakdown"))


for _bucket in ("hour", "day"):
    _stats(_bucket, "strftime(b, '%Y-%m-%d %H:%M:%S+00')")
_stats("ledger", "CAST(b AS VARCHAR)")


@query(
    "stats_contract_range",
    with_views(
        "SELECT strftime(b, '%Y-%m-%d %H:%M:%S+00') AS bucket, count(*) AS count FROM (SELECT date_trunc('day', ledger_closed_at) AS b FROM ev "
        f"WHERE contract_id = '{CONTRACT}' AND ledger_closed_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00') GROUP BY b"
    ),
)
def _stats_range(spark, sf):
    from datetime import datetime

    return A.contract_stats(M.ev(spark, sf), CONTRACT, "day", datetime(2024, 1, 5), datetime(2024, 1, 25))


@query("stats_total", with_views("SELECT count(*) AS total FROM ev"))
def _stats_total(spark, sf):
    return A.stats_total(A.contract_stats(M.ev(spark, sf), None, "day"))


@query(
    "agg_coverage",
    with_views(
        "SELECT contract_id, count(*) FILTER (WHERE has_enriched) AS enriched, count(*) FILTER (WHERE NOT has_enriched) AS not_enriched, "
        "count(*) FILTER (WHERE has_enriched) / count(*) AS rate FROM ev GROUP BY contract_id"
    ),
)
def _agg_coverage(spark, sf):
    return A.enrichment_coverage(M.ev(spark, sf), "contract_id")


@query(
    "agg_delivery_summary",
    with_views(
        "SELECT subscription_id, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'failed') AS failed, "
        "count(*) FILTER (WHERE status = 'pending') AS pending FROM deliv GROUP BY 1"
    ),
)
def _agg_delivery_summary(spark, sf):
    return A.delivery_summary(M.deliveries(spark, sf))


@query(
    "agg_delivery_newest",
    with_views(
        "SELECT id, subscription_id, status FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY created_s DESC, id DESC) AS r FROM deliv) WHERE r <= 50"
    ),
)
def _agg_delivery_newest(spark, sf):
    return A.newest_deliveries(M.deliveries(spark, sf)).select("id", "subscription_id", "status")


NOW_S = 996_624_030  # 2001-08-01 00:00:30 UTC


@query(
    "agg_delivery_health",
    with_views(
        f"""SELECT count(*) FILTER (WHERE status = 'pending') AS pending,
  CAST(coalesce({NOW_S} - min(created_s) FILTER (WHERE status = 'pending'), 0) AS BIGINT) AS oldest_pending_age_s,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'delivered') AS delivered,
  count(*) FILTER (WHERE status = 'delivered' AND delivered_s >= {NOW_S} - 60) AS delivered_last_minute,
  count(*) FILTER (WHERE status = 'failed' AND created_s >= {NOW_S} - 60) AS failed_last_minute FROM deliv"""
    ),
)
def _agg_delivery_health(spark, sf):
    return A.delivery_health(M.deliveries(spark, sf), F.timestamp_seconds(F.lit(NOW_S)))


@query(
    "agg_upgrades",
    with_views("SELECT contract_id, count(*) FILTER (WHERE version > 1) AS upgrades, count(*) FILTER (WHERE breaking) AS breaking_versions FROM upg GROUP BY 1"),
)
def _agg_upgrades(spark, sf):
    return A.upgrade_counts(M.upgrade_rows(spark, sf))


@query(
    "agg_route_latency",
    with_views(
        """SELECT route, method, count(*) AS count, CAST(sum(latency_ms) AS BIGINT) AS sum_ms,
  min(latency_ms) FILTER (WHERE r >= ceil(n * 50 / 100)) AS p50, min(latency_ms) FILTER (WHERE r >= ceil(n * 95 / 100)) AS p95,
  min(latency_ms) FILTER (WHERE r >= ceil(n * 99 / 100)) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY route, method ORDER BY latency_ms) AS r,
  count(*) OVER (PARTITION BY route, method) AS n FROM log) GROUP BY route, method"""
    ),
)
def _agg_route_latency(spark, sf):
    return A.route_stats(M.request_log(spark, sf))


@query("agg_route_status", with_views("SELECT route, method, status, count(*) AS count FROM log GROUP BY ALL"))
def _agg_route_status(spark, sf):
    return A.route_status(M.request_log(spark, sf))


# ---- discovery and sets


@query(
    "active_contracts", with_views("SELECT DISTINCT contract_id FROM ev")
)
def _active(spark, sf):
    return discovery.active_contracts(M.ev(spark, sf))


@query("seam_union", with_views(f"SELECT {_EVENT_OUT} FROM ev"))
def _seam(spark, sf):
    ev = _event_cols(M.ev(spark, sf))
    return merge.seam(ev.where(F.col("ledger") < PLACE[0] + 50_000), ev.where(F.col("ledger") >= PLACE[0] - 50_000))


@query("seam_union_overlap", with_views(f"SELECT {_EVENT_OUT} FROM ev"))
def _seam_overlap(spark, sf):
    ev = _event_cols(M.ev(spark, sf))
    low, high = PLACE[0] - 50_000, PLACE[0] + 49_999
    return merge.seam(ev.where(F.col("ledger") <= high), ev.where(F.col("ledger") >= low), (low, high))


# ---- appends and upserts


@query("sink_insert_new", with_views(f"SELECT {_EVENT_OUT} FROM ev WHERE ledger >= {PLACE[0]}"))
def _insert_new(spark, sf):
    ev = _event_cols(M.ev(spark, sf))
    incoming = ev.where(F.col("ledger") >= PLACE[0] - 100_000)
    return merge.insert_new(ev.where(F.col("ledger") < PLACE[0]), incoming.unionAll(incoming))


def _upsert_parts(spark, sf):
    ev = M.ev(spark, sf)
    old = ev.where(F.col("ledger") < PLACE[0])
    changed = F.when(F.col("in_successful_call"), F.col("decoded_value")).otherwise(F.lit('"changed"'))
    new = ev.where(F.col("ledger") >= PLACE[0] - 100_000)
    # Only decoded content may change: the renamed contract must not take effect.
    return old, new.withColumn("decoded_value", changed).withColumn(
        "contract_id", F.when(F.col("ledger") < PLACE[0], F.lit("moved")).otherwise(F.col("contract_id"))
    )


@query(
    "sink_upsert_reorg",
    with_views(
        f"""SELECT event_id, contract_id, ledger, event_name, CASE WHEN NOT in_successful_call AND ledger >= {PLACE[0] - 100_000} THEN 'changed' ELSE amount END AS amount,
  tx_hash FROM ev"""
    ),
)
def _upsert(spark, sf):
    return _event_cols(merge.upsert_events(*_upsert_parts(spark, sf))[0])


@query(
    "sink_upsert_stats",
    with_views(
        f"""SELECT count(*) FILTER (WHERE ledger >= {PLACE[0]}) AS inserted,
  count(*) FILTER (WHERE ledger >= {PLACE[0] - 100_000} AND ledger < {PLACE[0]} AND NOT in_successful_call) AS updated FROM ev"""
    ),
)
def _upsert_stats(spark, sf):
    table, stats = merge.upsert_events(*_upsert_parts(spark, sf))
    return counted(table, stats, "inserted", "updated")
