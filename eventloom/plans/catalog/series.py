"""Snapshots, versions, diffs, retention and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import interfaces as I
from eventloom.operators import gaps, monitor, reads, series, verticals
from eventloom.plans import mapping as M
from eventloom.plans.catalog import query, stamp, stamped
from eventloom.plans.oracle import stamp as sql_stamp
from eventloom.plans.oracle import with_views
from eventloom.session import shared_dir
from eventloom.sources import snapshots

TIP, KEEP = 341_300_000, 300_000
FIRST = TIP - KEEP


# ---- snapshots


@query("snap_state", with_views("SELECT contract_id, ledger, storage FROM cstate WHERE ledger >= 341000000"))
def _snap_state(spark, sf):
    st = M.contract_states(spark, sf)
    stored = st.where("ledger < 341000000")
    return series.snapshot_state(stored, st.where("ledger >= 340900000"))


@query(
    "snap_data",
    with_views(
        "SELECT contract_id, key_hash, ledger, arg_min(value, (key, label, durability, value)) AS value FROM cdata WHERE ledger >= 3410000000 GROUP BY ALL"
    ),
)
def _snap_data(spark, sf):
    cd = M.contract_data(spark, sf).select("contract_id", "key_hash", "ledger", "key", "label", "durability", "value")
    new = series.snapshot_data(cd.where("ledger < 3410000000"), cd.where("ledger >= 3409000000"))
    return new.select("contract_id", "key_hash", "ledger", "value")


# ---- versions and diffs


@query(
    "version_history",
    with_views(f"SELECT contract_id, version, wasm_hash, previous_wasm_hash, {sql_stamp('observed_at')} AS observed_at FROM versions"),
)
def _version_history(spark, sf):
    return stamped(I.build_versions(M.observations(spark, sf)), "observed_at")


@query(
    "version_history_resumed",
    with_views(f"SELECT contract_id, version, wasm_hash, previous_wasm_hash, {sql_stamp('observed_at')} AS observed_at FROM versions"),
)
def _version_history_resumed(spark, sf):
    """Built in two steps, the second on top of the stored first."""
    obs = M.observations(spark, sf)
    half = F.col("observed_at") < F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    stored = I.build_versions(obs.where(half))
    later = I.build_versions(obs.where(~half), stored)
    return stamped(stored.unionByName(later), "observed_at")


@query("q_history", with_views(f"SELECT contract_id, version, wasm_hash, previous_wasm_hash, {sql_stamp('observed_at')} AS observed_at FROM versions WHERE contract_id = 'C003' ORDER BY version DESC LIMIT 50"))
def _q_history(spark, sf):
    return stamped(reads.interface_history(I.build_versions(M.observations(spark, sf)), "C003"), "observed_at")


@query(
    "spec_current",
    with_views(f"SELECT contract_id, arg_max(wasm_hash, (observed_at, obs_id)) AS wasm_hash, arg_max(obs_id, (observed_at, obs_id)) % 3 = 0 AS has_events, {sql_stamp('max(observed_at)')} AS fetched_at FROM obs GROUP BY 1"),
)
def _spec_current(spark, sf):
    # Interfaces with events, without events, and none at all.
    kind = F.col("obs_id") % 3
    listed = F.when(kind == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    one = F.when(kind < 2, F.struct(listed.alias("events"))).alias("interface")
    return stamped(I.current_specs(M.observations(spark, sf).select("*", one)).drop("interface"), "fetched_at")


_CHANGES = """changes AS (SELECT coalesce(o.contract_id, n.contract_id) AS contract_id, coalesce(o.version + 1, n.version) AS version,
  coalesce(o.section, n.section) AS section, coalesce(o.name, n.name) AS name, o.signature AS before, n.signature AS after,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS action
  FROM (SELECT * FROM items WHERE version < 3) o FULL OUTER JOIN (SELECT * FROM items WHERE version > 1) n
  ON o.contract_id = n.contract_id AND o.version + 1 = n.version AND o.section = n.section AND o.name = n.name
  WHERE o.signature IS DISTINCT FROM n.signature)"""
_LINE = """action || ' ' || rtrim(section, 's') || ' ' || CASE WHEN action = 'changed' THEN name || ': ' || before || ' became ' || after ELSE coalesce(before, after) END"""
_RANKED = "CASE section WHEN 'functions' THEN 0 WHEN 'events' THEN 1 ELSE 2 END, CASE action WHEN 'removed' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END, name"


def _pairs(spark, sf):
    items = M.items(spark, sf)
    old = items.where("version < 3").withColumn("version", F.col("version") + 1)
    return old, items.where("version > 1")


@query("diff_versions", with_views("SELECT contract_id, version, section, name, action, before, after FROM changes", _CHANGES))
def _diff_versions(spark, sf):
    return I.change_rows(*_pairs(spark, sf), keys=("contract_id", "version"))


@query(
    "diff_summary",
    with_views(f"SELECT contract_id, version, string_agg({_LINE}, ' | ' ORDER BY {_RANKED}) AS lines, bool_or(action <> 'added') AS breaking FROM changes GROUP BY 1, 2", _CHANGES),
)
def _diff_summary(spark, sf):
    diffs = I.diff_interfaces(*_pairs(spark, sf), keys=("contract_id", "version"))
    return diffs.select("contract_id", "version", F.array_join(I.diff_summary(F.col("changes")), " | ").alias("lines"), "breaking")


@query(
    "version_diffs",
    with_views(
        """SELECT v.contract_id, v.version, coalesce(c.breaking, false) AS breaking, CASE WHEN cur.version IS NOT NULL AND prev.version IS NOT NULL THEN coalesce(c.n, 0) END AS n
  FROM v LEFT JOIN (SELECT DISTINCT contract_id, version FROM items) cur USING (contract_id, version)
  LEFT JOIN (SELECT DISTINCT contract_id, version + 1 AS version FROM items) prev USING (contract_id, version)
  LEFT JOIN (SELECT contract_id, version, bool_or(action <> 'added') AS breaking, count(*) AS n FROM changes GROUP BY 1, 2) c
    ON c.contract_id = v.contract_id AND c.version = v.version AND cur.version IS NOT NULL AND prev.version IS NOT NULL""",
        f"{_CHANGES}, v AS (SELECT DISTINCT contract_id, unnest([1, 2, 3, 4]) AS version FROM items)",
    ),
)
def _version_diffs(spark, sf):
    items = M.items(spark, sf)
    versions = items.select("contract_id").distinct().select("contract_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("version"))
    done = I.version_diffs(versions, items)
    return done.select("contract_id", "version", "breaking", F.size("changes").cast("bigint").alias("n"))


@query(
    "q_interface",
    with_views(
        "SELECT contract_id, version, wasm_hash FROM versions WHERE contract_id = 'C003' AND version = 4 "
        "UNION ALL SELECT contract_id, NULL, arg_max(wasm_hash, (observed_at, obs_id)) FROM obs WHERE contract_id = 'C003' GROUP BY 1"
    ),
)
def _q_interface(spark, sf):
    obs = M.observations(spark, sf)
    specs = obs.groupBy("contract_id").agg(F.max_by("wasm_hash", F.struct("observed_at", "obs_id")).alias("wasm_hash"))
    versions = I.build_versions(obs).select("contract_id", "version", "wasm_hash")
    old = reads.interface(specs, versions, "C003", 4)
    return old.unionByName(reads.interface(specs, versions, "C003"), allowMissingColumns=True)


# ---- retention


@query("retain_events", with_views(f"SELECT event_id, contract_id, ledger FROM ev WHERE ledger >= {FIRST}"))
def _retain_events(spark, sf):
    return series.prune_events(M.ev(spark, sf), TIP, KEEP).select("event_id", "contract_id", "ledger")


@query(
    "retain_state",
    with_views(
        "SELECT contract_id, ledger, storage FROM (SELECT *, max(ledger) OVER (PARTITION BY contract_id) AS newest FROM cstate) WHERE ledger >= 341329500 OR ledger = newest"
    ),
)
def _retain_state(spark, sf):
    return series.prune_state(M.contract_states(spark, sf), 341_330_500, 1_000)


@query(
    "retain_data",
    with_views(
        "SELECT contract_id, key_hash, ledger, label, value FROM (SELECT *, max(ledger) OVER (PARTITION BY contract_id, key_hash) AS newest FROM cdata) WHERE ledger >= 3413200000 OR ledger = newest"
    ),
)
def _retain_data(spark, sf):
    kept = series.prune_data(M.contract_data(spark, sf), 3_413_300_000, 100_000)
    return kept.select("contract_id", "key_hash", "ledger", "label", "value")


@query(
    "retain_data_stored",
    with_views(
        "SELECT contract_id, key_hash, ledger, label, value FROM (SELECT *, max(ledger) OVER (PARTITION BY contract_id, key_hash) AS newest FROM cdata) WHERE ledger >= 3413200000 OR ledger = newest"
    ),
)
def _retain_data_stored(spark, sf):
    """The same over stored folders, with the cut moved twice."""
    base, keys, width = shared_dir(spark, "series"), ["contract_id", "key_hash"], 172_800
    snapshots.write_snapshots(M.contract_data(spark, sf), f"{base}/rows", keys, width=width)
    snapshots.move_cut(spark, f"{base}/rows", keys, 3_411_000_000, f"{base}/carried-1", width=width)
    snapshots.move_cut(spark, f"{base}/rows", keys, 3_413_200_000, f"{base}/carried-2", f"{base}/carried-1", 3_411_000_000, width)
    kept = snapshots.read_snapshots(spark, f"{base}/rows", 3_413_200_000, f"{base}/carried-2", width)
    return kept.select("contract_id", "key_hash", "ledger", "label", "value")


@query("retain_cascade", with_views(f"SELECT event_id, kind FROM transfers WHERE ledger >= {FIRST}"))
def _retain_cascade(spark, sf):
    ev = M.ev(spark, sf)
    return series.cascade(verticals.token_transfers(ev), series.prune_events(ev, TIP, KEEP)).select("event_id", "kind")


@query(
    "retain_cascade_deliveries",
    with_views(f"SELECT id, status FROM deliv d WHERE event_id IS NULL OR EXISTS (SELECT 1 FROM ev e WHERE e.event_id = d.event_id AND e.ledger >= {FIRST})"),
)
def _retain_cascade_deliveries(spark, sf):
    kept = series.prune_events(M.ev(spark, sf), TIP, KEEP)
    return series.cascade(M.deliveries(spark, sf), kept).select("id", "status")


# ---- monitoring

NEWEST, OLDEST = sql_stamp('max("at")'), sql_stamp('min("at")')
AT = sql_stamp('"at"') + ' AS "at"'


_TOTALS = """CAST(sum(n % 17) AS BIGINT) AS ingested_total, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors_total,
  CAST(sum(n % 11) AS BIGINT) AS enriched_total, CAST(sum(n % 6) AS BIGINT) AS not_enriched_total, CAST(sum(n % 2) AS BIGINT) AS spec_failures_total,
  CAST(sum(n % 5 + 1) AS BIGINT) AS rpc_calls_total, CAST(sum(n % 3) AS BIGINT) AS rpc_errors_total, count(*) FILTER (WHERE n % 13 = 0) AS rpc_errors_range_total"""


@query(
    "status_fold",
    with_views(
        f"""SELECT arg_max(last_ledger, ("at", n)) AS last_processed_ledger, arg_max(last_ledger + n % 150, ("at", n)) AS chain_tip_ledger, {_TOTALS},
  {NEWEST} AS updated_at, count(*) AS stored_events FROM cyc"""
    ),
)
def _status_fold(spark, sf):
    return stamped(monitor.status(M.cycles(spark, sf), M.ev(spark, sf)), "updated_at")


@query(
    "health",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'starting' WHEN age <= 120 AND lag < 100 THEN 'ok' ELSE 'degraded' END AS state,
  CASE WHEN o_orderstatus <> 'P' THEN lag END AS lag_ledgers, CASE WHEN o_orderstatus <> 'P' THEN lag * 5 END AS lag_seconds,
  CASE WHEN o_orderstatus <> 'P' THEN age END AS age_seconds, o_orderstatus <> 'P' AND age <= 60 AND lag < 50 AS ready
  FROM (SELECT *, greatest(o_orderkey % 150 - 10, 0) AS lag, o_custkey % 200 AS age FROM orders)""",
)
def _health(spark, sf):
    o = M.table(spark, sf, "orders")
    known = F.col("o_orderstatus") != "P"
    rows = o.select(
        "o_orderkey", F.when(known, F.col("o_custkey")).alias("last_processed_ledger"),
        (F.col("o_custkey") + F.col("o_orderkey") % 150 - 10).alias("chain_tip_ledger"),
        F.timestamp_seconds(F.lit(1_000_000_000) - F.col("o_custkey") % 200).alias("updated_at"),
    )
    checked = monitor.health(rows, F.timestamp_seconds(F.lit(1_000_000_000)), max_age=60, max_lag=50)
    return checked.select("o_orderkey", "state", "lag_ledgers", "lag_seconds", "age_seconds", "ready")


@query(
    "series_rate",
    with_views(
        f"SELECT instance, {AT}, ingested_increase, errors_increase, ingested_increase / 300.0 AS ingested_rate, errors_increase / 300.0 AS errors_rate FROM grown"
    ),
)
def _series_rate(spark, sf):
    found = monitor.rate(M.samples(spark, sf), ["ingested", "errors"])
    return found.select("instance", stamp("at"), "ingested_increase", "errors_increase", "ingested_rate", "errors_rate")


@query("series_delta", with_views(f"SELECT instance, {AT}, lag_delta FROM grown"))
def _series_delta(spark, sf):
    return monitor.trailing(M.samples(spark, sf), deltas={"lag": 3600}).select("instance", stamp("at"), "lag_delta")


_RULES = [
    ("IndexerLagHigh", "warning", 300, "lag > 100"),
    ("IndexerLagCritical", "critical", 120, "lag > 500"),
    ("IndexerStalled", "critical", 300, "ingested_increase = 0 AND lag > 0"),
    ("IndexerErrorRateHigh", "warning", 120, "errors_increase / 300.0 > 0.01 AND errors_increase > 0"),
    ("LargeLagGrowth", "warning", 300, "lag_delta > 1000"),
    ("IngestRateLow", "warning", 600, "ingested_increase / 300.0 < 1"),
    ("APINoRequests", "warning", 300, "requests_increase = 0"),
]
_TESTED = " UNION ALL ".join(f"SELECT instance, \"at\", t, '{a}' AS alert, '{s}' AS severity, {h} AS hold, {c} AS is_on FROM grown" for a, s, h, c in _RULES)


@query(
    "alerts",
    with_views(
        f"""SELECT instance, alert, severity, {OLDEST} AS started_at, CAST(min(t) + hold AS BIGINT) AS fired_at, {NEWEST} AS ended_at
  FROM islands WHERE is_on GROUP BY instance, alert, severity, hold, island HAVING max(t) - min(t) >= hold""",
        f"""tested AS ({_TESTED}), flagged AS (SELECT *, is_on AND NOT coalesce(lag(is_on) OVER (PARTITION BY instance, alert ORDER BY t), false) AS starts FROM tested),
  islands AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY instance, alert ORDER BY t) AS island FROM flagged)""",
    ),
)
def _alerts(spark, sf):
    found = monitor.evaluate_alerts(M.samples(spark, sf)).withColumn("fired_at", F.unix_seconds("fired_at"))
    return stamped(found, "started_at", "ended_at")


def _requests(spark, sf):
    o = M.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(k % 3 != 0, F.lit(800_000) + k * 13 % 250_000).alias("cursor"),
        F.when(k % 2 == 0, F.lit(850_000) + k % 1000).otherwise(F.lit(0).cast("bigint")).alias("start"),
        (F.lit(1_000_000) + k % 7).alias("tip"),
    )


_PLAN = """planned AS (SELECT *, greatest(asked, tip - 120000) AS served FROM (SELECT *, coalesce(cursor + 1, CASE WHEN start > 0 THEN start END, tip) AS asked FROM
  (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 800000 + o_orderkey * 13 % 250000 END AS cursor,
  CASE WHEN o_orderkey % 2 = 0 THEN 850000 + o_orderkey % 1000 ELSE 0 END AS start, 1000000 + o_orderkey % 7 AS tip FROM orders))),
  final AS (SELECT *, CASE WHEN tip - served > 4000 THEN tip - 4000 ELSE served END AS final FROM planned)"""


@query("st_start", with_views("SELECT id, CASE WHEN asked <= tip THEN final END AS start_ledger FROM final", _PLAN))
def _st_start(spark, sf):
    return monitor.plan_start(_requests(spark, sf)).select("id", "start_ledger")


@query(
    "st_start_gaps",
    with_views(
        """SELECT id, asked AS from_ledger, served - 1 AS to_ledger, 'retention' AS reason FROM final WHERE asked <= tip AND asked < served
  UNION ALL SELECT id, served, final - 1, 'catchup' FROM final WHERE asked <= tip AND served < final""",
        _PLAN,
    ),
)
def _st_start_gaps(spark, sf):
    return monitor.start_gaps(monitor.plan_start(_requests(spark, sf))).select("id", "from_ledger", "to_ledger", "reason")


# ---- ranges skipped and filled later

_RANGES = f"""{_PLAN}, skipped AS (SELECT id % 7 AS instance, asked AS f, served - 1 AS t FROM final WHERE asked <= tip AND asked < served
  UNION ALL SELECT id % 7, served, final - 1 FROM final WHERE asked <= tip AND served < final),
  filled AS (SELECT o_orderkey % 7 AS instance, 800000 + o_orderkey * 7919 % 190000 AS f, 800000 + o_orderkey * 7919 % 190000 + o_orderkey % 90 - 10 AS t FROM orders WHERE o_orderkey % 5 < 3),
  steps AS (SELECT instance, f AS p, 1 AS s, 0 AS d FROM skipped UNION ALL SELECT instance, t + 1, -1, 0 FROM skipped
    UNION ALL SELECT instance, f, 0, 1 FROM filled WHERE f <= t UNION ALL SELECT instance, t + 1, 0, -1 FROM filled WHERE f <= t),
  level AS (SELECT instance, p, sum(sum(s)) OVER w AS s, sum(sum(d)) OVER w AS d, lead(p) OVER w AS q FROM steps GROUP BY instance, p WINDOW w AS (PARTITION BY instance ORDER BY p)),
  opened AS (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY instance ORDER BY p) = p THEN 0 ELSE 1 END AS fresh FROM level WHERE s > 0 AND d = 0),
  runs AS (SELECT *, sum(fresh) OVER (PARTITION BY instance ORDER BY p) AS run FROM opened),
  gaps AS (SELECT instance, min(p) AS from_ledger, max(q) - 1 AS to_ledger FROM runs GROUP BY instance, run)"""


def _open_gaps(spark, sf):
    skipped = monitor.start_gaps(monitor.plan_start(_requests(spark, sf))).withColumn("instance", F.col("id") % 7)
    k = F.col("o_orderkey")
    first = F.lit(800_000) + k * 7919 % 190_000
    filled = M.table(spark, sf, "orders").where(k % 5 < 3).select((k % 7).alias("instance"), first.alias("from_ledger"), (first + k % 90 - 10).alias("to_ledger"))
    return gaps.open_gaps(skipped, filled, chunk=50_000)


@query("st_open_gaps", with_views("SELECT instance, from_ledger, to_ledger FROM gaps", _RANGES))
def _st_open_gaps(spark, sf):
    return _open_gaps(spark, sf)


@query(
    "st_backfill_jobs",
    with_views("SELECT instance, f AS from_ledger, least(f + 3999, to_ledger) AS to_ledger FROM (SELECT instance, to_ledger, unnest(range(from_ledger, to_ledger + 1, 4000)) AS f FROM gaps)", _RANGES),
)
def _st_backfill_jobs(spark, sf):
    return gaps.backfill_jobs(_open_gaps(spark, sf))
