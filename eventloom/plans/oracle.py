"""SQL twins of the mapping views, for checking results in another engine."""

from __future__ import annotations

import re


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


_ISO = "strftime(ledger_closed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"

# An event row as the canonical JSON payload.
EVENT_JSON = f"""'{{"contract_id":"' || contract_id || '","created_at":"' || {_ISO} ||
 '","decoded_topics":[' || coalesce('"' || event_name || '"', '7') || ',"' || topic1 || '","' || topic2 ||
 '"],"decoded_value":"' || amount || '","enriched":' ||
 CASE WHEN has_enriched THEN '{{"event":"' || coalesce(event_name, 'view') ||
   '","params":{{"k":{{"type":"u32","value":"' || k || '"}}}}}}' ELSE 'null' END ||
 ',"event_id":"' || event_id || '","event_name":' || coalesce('"' || event_name || '"', 'null') ||
 ',"event_type":"contract","in_successful_call":' || CAST(in_successful_call AS VARCHAR) ||
 ',"ledger":' || ledger || ',"ledger_closed_at":"' || {_ISO} || '","paging_token":"' || event_id ||
 '","topics":[],"tx_hash":"' || tx_hash || '","value":""}}'"""

VIEWS = {
    "ev": """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, event_id AS n, user_id,
  'C' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') AS contract_id,
  CAST(floor(epoch(ts) / 5) AS BIGINT) AS ledger, ts AS ledger_closed_at,
  CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'mint' WHEN 'click' THEN 'burn'
    WHEN 'error' THEN 'clawback' END AS event_name,
  'G' || user_id AS topic1, 'G' || ((user_id * 7 + event_id) % 100) AS topic2,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount,
  json_extract_string(props, '$.k') AS k, event_id % 4 <> 0 AS has_enriched,
  'tx' || (event_id // 3) AS tx_hash, event_type <> 'error' AS in_successful_call FROM events""",
    "li": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id,
  'C' || (l_suppkey % 10) AS contract_id, CAST(floor(epoch(l_shipdate) / 5) AS BIGINT) AS ledger,
  l_shipdate AS ledger_closed_at, l_returnflag AS flag, l_linenumber AS n, l_partkey, l_suppkey,
  'P' || l_partkey AS p, 'S' || l_suppkey AS s, 'U' || l_orderkey AS u,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS price,
  CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR) AS qty FROM lineitem""",
    "transfers": """SELECT event_id, contract_id, CASE WHEN event_name <> 'mint' THEN topic1 END AS from_addr,
  CASE event_name WHEN 'transfer' THEN topic2 WHEN 'mint' THEN topic1 END AS to_addr, amount,
  event_name AS kind, ledger, ledger_closed_at FROM ev WHERE event_name IS NOT NULL""",
    "swaps": """SELECT event_id, contract_id, CASE WHEN n % 2 = 0 THEN u END AS sender, p AS sell_token, s AS buy_token,
  price AS sell_amount, qty AS buy_amount, CASE flag WHEN 'A' THEN 'swap' ELSE 'trade' END AS raw_event_name,
  ledger, ledger_closed_at FROM li WHERE flag IN ('A', 'N')""",
    "nfts": """SELECT event_id, contract_id, CASE flag WHEN 'A' THEN 'mint' WHEN 'N' THEN 'transfer' ELSE 'burn' END AS event_kind,
  CASE WHEN flag <> 'A' THEN u END AS from_addr, CASE flag WHEN 'N' THEN s WHEN 'A' THEN u END AS to_addr,
  CASE WHEN n % 3 = 1 THEN CAST(l_partkey AS VARCHAR) ELSE '{"id":' || l_partkey || '}' END AS token_id,
  ledger, ledger_closed_at FROM li WHERE n % 3 <> 0 AND n % 5 <> 0""",
    "liquidity": """SELECT event_id, contract_id, CASE WHEN n % 2 = 0 THEN 'add' ELSE 'remove' END AS event_kind, u AS provider,
  price AS amount_a, CASE WHEN n % 3 >= 1 THEN qty END AS amount_b, CAST(l_suppkey AS VARCHAR) AS shares,
  CASE n % 4 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdraw' WHEN 2 THEN 'add_liquidity' ELSE 'remove_liquidity' END AS raw_event_name,
  CASE WHEN n % 3 = 2 THEN '["' || l_partkey || '"]' END AS extra_amounts, ledger, ledger_closed_at FROM li""",
    "cdata": """SELECT 'C' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') AS contract_id, sha256('G' || user_id) AS key_hash,
  '"G' || user_id || '"' AS key, CAST(floor(epoch(ts) / 5) AS BIGINT) * 10 + event_id % 10 AS ledger,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'balance' ELSE 'allowance' END AS label,
  'persistent' AS durability, '"' || CAST(round(value * 100) AS BIGINT) || '"' AS value FROM events""",
    "cstate": """SELECT contract_id, ledger, max('"' || amount || '"') AS storage FROM ev WHERE event_name = 'mint'
  GROUP BY contract_id, ledger""",
    "obs": """SELECT 'C' || lpad(CAST(user_id % 10 AS VARCHAR), 3, '0') AS contract_id,
  'h' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS wasm_hash, ts AS observed_at, event_id AS obs_id
  FROM events WHERE event_type = 'signup'""",
    "seen": """SELECT *, lag(wasm_hash) OVER (PARTITION BY contract_id ORDER BY observed_at, obs_id) AS previous_wasm_hash FROM obs""",
    "versions": """SELECT contract_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY observed_at, obs_id) AS INT) AS version,
  wasm_hash, previous_wasm_hash, observed_at FROM seen WHERE wasm_hash IS DISTINCT FROM previous_wasm_hash""",
    "items": """SELECT p_brand AS contract_id, p_size % 3 + 1 AS version,
  CASE p_partkey % 3 WHEN 0 THEN 'functions' WHEN 1 THEN 'events' ELSE 'types' END AS section, p_type AS name,
  min(p_type || '(' || (p_size % 5) || ')') AS signature FROM part GROUP BY 1, 2, 3, 4""",
    "subs": """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey AS k, 'https://hooks.example/' || n_name AS url,
  CASE WHEN n_nationkey % 5 = 0 THEN 'upgrade' ELSE 'event' END AS kind,
  CASE WHEN n_nationkey % 3 <> 0 THEN 'C' || lpad(CAST(n_nationkey % 10 AS VARCHAR), 3, '0') END AS contract_id,
  CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 2 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'transfer' ELSE 'mint' END AS event_name,
  'secret-' || n_nationkey AS secret, n_nationkey % 7 <> 0 AS active, CAST(1700000000 + n_nationkey * 60 AS BIGINT) AS created_s,
  CASE WHEN n_nationkey % 7 = 0 THEN CAST(1710000000 + n_nationkey AS BIGINT) END AS disabled_s,
  CASE WHEN n_nationkey % 7 = 0 THEN 'manual' END AS reason, n_nationkey % 4 AS consecutive_failures FROM nation""",
    "deliv": """SELECT o_orderkey AS id, CAST(o_custkey % 25 AS VARCHAR) AS subscription_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS event_id,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey END AS upgrade_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'delivered' END AS status,
  CAST(o_orderkey % 7 AS INT) AS attempts, CASE WHEN o_orderstatus = 'F' THEN 'non-2xx status 500' END AS last_error,
  CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 48 * 3600 AS next_s,
  CASE WHEN o_orderstatus = 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) + 30 END AS delivered_s,
  CAST(epoch(o_orderdate) AS BIGINT) AS created_s FROM orders""",
    "outc": """SELECT id AS delivery_id, subscription_id, id % 3 = 0 AS ok,
  CASE WHEN id % 3 <> 0 THEN 'non-2xx status ' || (500 + id % 4) END AS error, next_s AS at_s FROM deliv WHERE status = 'pending'""",
    "upg": """SELECT o_orderkey AS id, 'C' || lpad(CAST(o_custkey % 10 AS VARCHAR), 3, '0') AS contract_id,
  CAST(o_orderkey % 50 // 10 + 1 AS INT) AS version, 'h' || o_orderkey AS wasm_hash, 'h' || (o_orderkey - 10) AS previous_wasm_hash,
  o_orderkey % 3 = 0 AS breaking, CASE WHEN o_orderkey % 4 = 0 THEN '{"breaking":false}' END AS diff,
  o_orderdate AS observed_at FROM orders WHERE o_orderkey % 10 = 0""",
    "log": """SELECT '/contracts/{id}/' || event_type AS route, 'GET' AS method, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM events""",
    "per_minute": """SELECT 'i' || (user_id % 2) AS instance, date_trunc('minute', ts) AS "at", count(*) AS n,
  count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'view') AS r,
  max(CAST(floor(value * 10) AS BIGINT)) AS lag FROM events GROUP BY 1, 2""",
    "samples": """SELECT instance, "at", CAST(epoch("at") AS BIGINT) AS t,
  CAST(sum(n) OVER d AS BIGINT) AS ingested, CAST(sum(e) OVER d AS BIGINT) AS errors, CAST(sum(r) OVER d AS BIGINT) AS requests, lag
  FROM per_minute WINDOW d AS (PARTITION BY instance, CAST("at" AS DATE) ORDER BY "at" ROWS UNBOUNDED PRECEDING)""",
    # Running totals that count a drop as a restart from zero.
    "stepped": """SELECT *, CASE WHEN ingested < lag(ingested) OVER s THEN ingested ELSE ingested - lag(ingested) OVER s END AS d_ingested,
  CASE WHEN errors < lag(errors) OVER s THEN errors ELSE errors - lag(errors) OVER s END AS d_errors,
  CASE WHEN requests < lag(requests) OVER s THEN requests ELSE requests - lag(requests) OVER s END AS d_requests
  FROM samples WINDOW s AS (PARTITION BY instance ORDER BY t)""",
    "totals": """SELECT *, sum(coalesce(d_ingested, 0)) OVER s AS c_ingested, sum(coalesce(d_errors, 0)) OVER s AS c_errors,
  sum(coalesce(d_requests, 0)) OVER s AS c_requests
  FROM stepped WINDOW s AS (PARTITION BY instance ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "grown": """SELECT instance, "at", t, lag, CAST(c_ingested - first(c_ingested) OVER w AS BIGINT) AS ingested_increase,
  CAST(c_errors - first(c_errors) OVER w AS BIGINT) AS errors_increase,
  CAST(c_requests - first(c_requests) OVER w AS BIGINT) AS requests_increase, lag - first(lag) OVER h AS lag_delta
  FROM totals WINDOW w AS (PARTITION BY instance ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW),
  h AS (PARTITION BY instance ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""",
    "cyc": """SELECT event_id AS n, ts AS "at", CAST(floor(epoch(ts) / 5) AS BIGINT) AS last_ledger, event_type FROM events""",
}


def _needs(sql: str) -> list[str]:
    """Views a text refers to, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str, extra: str = "") -> str:
    """The statement with its mapping views in front; ``extra`` adds CTEs."""
    names = _needs(sql + " " + extra)
    parts = [f"{name} AS ({VIEWS[name]})" for name in names]
    if extra:
        parts.append(extra)
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def strkey_ctes(source: str, name: str = "keytext") -> str:
    """CTEs that give ``name(k, txt)``: key text of ``source`` (k, hx), where
    hx is 33 bytes of hex (version byte first)."""
    t = "xor(c >> 8, x)"
    u = f"xor({t}, ({t}) >> 4)"
    step = f"xor(xor(c << 8, ({u}) << 12), xor(({u}) << 5, {u})) & 65535"
    return f"""{name}_b AS (SELECT k, list_transform(range(0, 33), lambda i: CAST('0x' || substr(hx, CAST(i * 2 + 1 AS INT), 2) AS BIGINT)) AS b FROM ({source})),
{name}_c AS (SELECT k, b, list_reduce(list_concat([0::BIGINT], b), lambda c, x: {step}) AS crc FROM {name}_b),
{name}_f AS (SELECT k, list_concat(b, [crc & 255, crc >> 8]) AS f FROM {name}_c),
{name} AS (SELECT k, array_to_string(list_transform(range(0, 56), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + (((f[i * 5 // 8 + 1] << 8 | coalesce(f[i * 5 // 8 + 2], 0)) >> (11 - i * 5 % 8)) & 31) AS INT), 1)), '') AS txt FROM {name}_f)"""
