"""Subscription matching and the delivery queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import deliveries as D
from eventloom.operators import matching
from eventloom.plans import mapping as M
from eventloom.plans.catalog import query
from eventloom.plans.oracle import EVENT_JSON, with_views
from eventloom.session import shared_dir
from eventloom.sources import queue

# 1999-01-01 00:00:00 UTC
NOW_S = 915_148_800


def now():
    return F.timestamp_seconds(F.lit(NOW_S))

MATCHES = """SELECT s.id AS subscription_id, e.event_id FROM ev e JOIN subs s ON s.active AND s.kind = 'event'
  AND (s.contract_id IS NULL OR s.contract_id = e.contract_id) AND (s.event_name IS NULL OR s.event_name = e.event_name)"""
UPGRADES = """SELECT s.id AS subscription_id, v.id AS upgrade_id FROM upg v JOIN subs s ON s.active AND s.kind = 'upgrade'
  AND (s.contract_id IS NULL OR s.contract_id = v.contract_id) WHERE v.version > 1"""


def seconds(df, *cols):
    """Timestamps as epoch seconds, named as in the SQL twins."""
    for c in cols:
        df = df.withColumn(c, F.unix_seconds(c))
    return df


@query("match_events", with_views(MATCHES))
def _match_events(spark, sf):
    return matching.match_events(M.ev(spark, sf), M.subscriptions(spark, sf))


@query("match_upgrades", with_views(UPGRADES))
def _match_upgrades(spark, sf):
    return matching.match_upgrades(M.upgrade_rows(spark, sf), M.subscriptions(spark, sf))


@query(
    "enqueue",
    with_views(
        f"""SELECT subscription_id, event_id, upgrade_id, 'pending' AS status, 0 AS attempts, CAST({NOW_S} AS BIGINT) AS next_attempt_at FROM (
  SELECT subscription_id, event_id, NULL AS upgrade_id FROM m WHERE NOT EXISTS (SELECT 1 FROM deliv d WHERE d.subscription_id = m.subscription_id AND d.event_id = m.event_id)
  UNION ALL SELECT subscription_id, NULL, upgrade_id FROM u WHERE NOT EXISTS (SELECT 1 FROM deliv d WHERE d.subscription_id = u.subscription_id AND d.upgrade_id = u.upgrade_id))""",
        f"m AS ({MATCHES}), u AS ({UPGRADES})",
    ),
)
def _enqueue(spark, sf):
    events = matching.match_events(M.ev(spark, sf), M.subscriptions(spark, sf))
    upgrades = matching.match_upgrades(M.upgrade_rows(spark, sf), M.subscriptions(spark, sf))
    both = events.unionByName(upgrades, allowMissingColumns=True)
    made = D.enqueue(M.deliveries(spark, sf), both, now())
    return seconds(made.select("subscription_id", "event_id", "upgrade_id", "status", "attempts", "next_attempt_at"), "next_attempt_at")


_UPGRADE_JSON = """'{"breaking":' || CAST(v.breaking AS VARCHAR) || ',"contract_id":"' || v.contract_id || '","diff":' || coalesce(v.diff, 'null') ||
  ',"observed_at":"' || strftime(v.observed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","previous_wasm_hash":"' || v.previous_wasm_hash ||
  '","type":"contract.upgraded","version":' || v.version || ',"wasm_hash":"' || v.wasm_hash || '"}'"""
DUE = f"""due AS (SELECT d.id, d.subscription_id, d.attempts, s.url, s.secret,
  CASE WHEN d.upgrade_id IS NOT NULL THEN {_UPGRADE_JSON} ELSE p.payload END AS payload
  FROM deliv d JOIN subs s ON s.id = d.subscription_id LEFT JOIN (SELECT event_id, {EVENT_JSON} AS payload FROM ev) p ON p.event_id = d.event_id
  LEFT JOIN upg v ON v.id = d.upgrade_id WHERE d.status = 'pending' AND d.next_s <= {NOW_S})"""


def _due(spark, sf, **kwargs):
    found = D.due_deliveries(M.deliveries(spark, sf), M.subscriptions(spark, sf), M.ev(spark, sf), M.upgrade_rows(spark, sf), now(), **kwargs)
    return found.drop("next_attempt_at")


@query("due_payloads", with_views("SELECT * FROM due", DUE))
def _due_payloads(spark, sf):
    return _due(spark, sf)


@query(
    "due_batch",
    with_views(f"SELECT id, subscription_id, attempts FROM deliv WHERE status = 'pending' AND next_s <= {NOW_S} ORDER BY next_s, id LIMIT 100"),
)
def _due_batch(spark, sf):
    found = D.due_deliveries(M.deliveries(spark, sf), M.subscriptions(spark, sf), M.ev(spark, sf), M.upgrade_rows(spark, sf), now(), 100)
    return found.select("id", "subscription_id", "attempts")


def _pad(byte: int) -> str:
    return f"""array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(kx, CAST(i * 2 + 1 AS INT), 2) AS INT), {byte}))), '')"""


@query(
    "sign_payloads",
    with_views(
        "SELECT id, CASE WHEN payload IS NOT NULL THEN 'sha256=' || sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(payload)))) END AS signature, "
        "CASE WHEN payload LIKE '%\"type\":\"contract.upgraded\"%' THEN 'contract.upgraded' ELSE 'contract.event' END AS event_header "
        f"FROM due JOIN (SELECT sid, {_pad(0x36)} AS ipad, {_pad(0x5C)} AS opad FROM (SELECT id AS sid, rpad(hex(encode(secret)), 128, '0') AS kx FROM subs)) ON sid = subscription_id",
        DUE,
    ),
)
def _sign_payloads(spark, sf):
    return D.sign(_due(spark, sf, with_pads=True)).select("id", "signature", "event_header")


@query(
    "apply_outcomes",
    with_views(
        f"""SELECT d.id, CASE WHEN o.ok THEN 'delivered' WHEN o.ok IS NOT NULL AND d.attempts + 1 >= 6 THEN 'failed' ELSE d.status END AS status,
  CAST(CASE WHEN o.ok IS NOT NULL THEN d.attempts + 1 ELSE d.attempts END AS INT) AS attempts,
  CASE WHEN o.ok THEN NULL WHEN o.ok IS NOT NULL THEN o.error ELSE d.last_error END AS last_error,
  CASE WHEN NOT o.ok AND d.attempts + 1 < 6 THEN CAST({NOW_S} + least(pow(2, d.attempts + 1), 3600) AS BIGINT) ELSE d.next_s END AS next_attempt_at,
  CASE WHEN o.ok THEN CAST({NOW_S} AS BIGINT) ELSE d.delivered_s END AS delivered_at FROM deliv d LEFT JOIN outc o ON o.delivery_id = d.id"""
    ),
)
def _apply_outcomes(spark, sf):
    done = D.apply_outcomes(M.deliveries(spark, sf), M.outcomes(spark, sf), now(), jitter="max")
    return seconds(done, "next_attempt_at", "delivered_at").select("id", "status", "attempts", "last_error", "next_attempt_at", "delivered_at")


@query(
    "queue_rounds",
    with_views(
        f"""SELECT d.id, CASE WHEN d.next_s >= {NOW_S} OR o.ok IS NULL THEN d.status WHEN o.ok THEN 'delivered' WHEN d.attempts + 1 >= 6 THEN 'failed' ELSE d.status END AS status,
  CAST(CASE WHEN d.next_s < {NOW_S} AND o.ok IS NOT NULL THEN d.attempts + 1 ELSE d.attempts END AS INT) AS attempts,
  CASE WHEN d.next_s < {NOW_S} AND NOT o.ok AND d.attempts + 1 < 6 THEN CAST({NOW_S} + least(pow(2, d.attempts + 1), 3600) AS BIGINT) ELSE d.next_s END AS next_attempt_at
  FROM deliv d LEFT JOIN outc o ON o.delivery_id = d.id"""
    ),
)
def _queue_rounds(spark, sf):
    """Two rounds over time buckets: half of what was due, then the rest; every delivery as it stands."""
    base, schema, width = f"{shared_dir(spark, 'queue')}/q", M.deliveries(spark, sf).schema, 32 * 86_400
    end = NOW_S // width
    middle = end - 40
    queue.put(M.deliveries(spark, sf), base, 0, 0, width)
    for number, start, upto in ((1, 0, middle), (2, middle, end)):
        rows = queue.due(spark, base, schema, number, start, upto)
        queue.settle(rows, M.outcomes(spark, sf), base, now(), number, upto, width, jitter="max")
    return seconds(queue.deliveries(spark, base, schema, end), "next_attempt_at").select("id", "status", "attempts", "next_attempt_at")


_RUNS = """ordered AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY subscription_id ORDER BY at_s, delivery_id) AS island FROM outc),
  runs AS (SELECT o.*, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY subscription_id, island ORDER BY at_s, delivery_id) +
    CASE WHEN island = 0 THEN s.consecutive_failures ELSE 0 END AS BIGINT) AS run FROM ordered o JOIN subs s ON s.id = o.subscription_id)"""


@query("failure_runs", with_views("SELECT delivery_id, run FROM runs", _RUNS))
def _failure_runs(spark, sf):
    start = M.subscriptions(spark, sf).select(F.col("id").alias("subscription_id"), "consecutive_failures")
    return D.failure_runs(M.outcomes(spark, sf), start).select("delivery_id", "run")


@query(
    "auto_disable",
    with_views(
        f"""SELECT s.id, s.active AND h.hit IS NULL AS active, CAST(coalesce(h.last, s.consecutive_failures) AS INT) AS consecutive_failures,
  CASE WHEN h.hit IS NOT NULL THEN CAST({NOW_S} AS BIGINT) ELSE s.disabled_s END AS auto_disabled_at,
  CASE WHEN h.hit IS NOT NULL THEN 'Auto-disabled after ' || h.hit || ' consecutive delivery failures' ELSE s.reason END AS auto_disabled_reason
  FROM subs s LEFT JOIN (SELECT subscription_id, arg_max(run, (at_s, delivery_id)) AS last,
    arg_min(run, (at_s, delivery_id)) FILTER (WHERE NOT ok AND run >= 10) AS hit FROM runs GROUP BY 1) h ON h.subscription_id = s.id""",
        _RUNS,
    ),
)
def _auto_disable(spark, sf):
    done = D.update_subscriptions(M.subscriptions(spark, sf), M.outcomes(spark, sf), now())
    return seconds(done, "auto_disabled_at").select("id", "active", "consecutive_failures", "auto_disabled_at", "auto_disabled_reason")


@query(
    "redrive",
    with_views(
        f"""SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE attempts END AS attempts,
  CASE WHEN NOT hit THEN last_error END AS last_error, CASE WHEN hit THEN CAST({NOW_S} AS BIGINT) ELSE next_s END AS next_attempt_at
  FROM (SELECT *, subscription_id = '3' AND status = 'failed' AND created_s >= 880000000 AS hit FROM deliv)"""
    ),
)
def _redrive(spark, sf):
    done = D.redrive(M.deliveries(spark, sf), "3", now(), F.timestamp_seconds(F.lit(880_000_000)))
    return seconds(done, "next_attempt_at").select("id", "status", "attempts", "last_error", "next_attempt_at")


@query(
    "reenable",
    with_views(
        """SELECT id, active OR id = '7' AS active, CASE WHEN id <> '7' THEN disabled_s END AS auto_disabled_at, CASE WHEN id <> '7' THEN reason END AS auto_disabled_reason,
  CAST(CASE WHEN id = '7' THEN 0 ELSE consecutive_failures END AS INT) AS consecutive_failures FROM subs"""
    ),
)
def _reenable(spark, sf):
    done = D.reenable(D.reenable(M.subscriptions(spark, sf), "7"), "8")
    return seconds(done, "auto_disabled_at").select("id", "active", "auto_disabled_at", "auto_disabled_reason", "consecutive_failures")


@query("list_subs", with_views("SELECT id, url, kind, contract_id, event_name, active, created_s AS created_at FROM subs"))
def _list_subs(spark, sf):
    shown = seconds(D.list_subscriptions(M.subscriptions(spark, sf)), "created_at")
    return shown.select("id", "url", "kind", "contract_id", "event_name", "active", "created_at")


def _requests(spark, sf):
    """A subscription request per customer, good and bad."""
    c = M.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        M.text("c_custkey").alias("id"),
        F.when(k % 5 == 0, "other").when(k % 2 == 0, "upgrade").otherwise("event").alias("kind"),
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("C003")).alias("contract_id"),
        F.when(k % 4 == 0, F.lit("transfer")).alias("event_name"),
    )


@query(
    "valid_subs",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'kind must be event or upgrade'
  WHEN c_custkey % 4 = 0 THEN 'upgrade takes no event_name' WHEN c_custkey % 3 = 0 THEN 'contract_id must not be empty' END AS reason FROM customer""",
)
def _valid_subs(spark, sf):
    ok, rejects = D.check_subscriptions(_requests(spark, sf))
    return ok.select("id", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select("id", "reason"))
