"""Progress, health and alert rules over counter samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Ledger cadence and health bounds.
LEDGER_SECONDS = 5
MAX_AGE_SECONDS, MAX_LAG = 120, 100
LOOKBACK_LEDGERS, MAX_CATCHUP = 120_000, 4_000
CYCLE_SUMS = (
    "ingested", "errors", "enriched", "not_enriched", "spec_failures", "rpc_calls", "rpc_errors", "rpc_errors_range",
)
DAY_SECONDS = 86_400


def status(cycles: DataFrame, ev: DataFrame | None = None) -> DataFrame:
    """Per-cycle log -> one status row: newest position, lifetime sums."""
    newest = F.struct("at", "cycle_id")
    folded = cycles.agg(
        F.max_by("last_ledger", newest).alias("last_processed_ledger"),
        F.max_by("tip_ledger", newest).alias("chain_tip_ledger"),
        *[F.sum(c).alias(f"{c}_total") for c in CYCLE_SUMS],
        F.max("at").alias("updated_at"),
    )
    if ev is None:
        return folded
    stored = ev.agg(F.count("*").alias("stored_events"))
    both = folded.unionByName(stored, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def health(status_rows: DataFrame, now: Column, max_age: int = MAX_AGE_SECONDS, max_lag: int = MAX_LAG) -> DataFrame:
    """State of each status row; a row that was never written is ``starting``."""
    lag = F.greatest(F.lit(0), F.col("chain_tip_ledger") - F.col("last_processed_ledger"))
    age = F.unix_seconds(now) - F.unix_seconds("updated_at")
    ok = (age <= MAX_AGE_SECONDS) & (lag < MAX_LAG)
    known = F.col("last_processed_ledger").isNotNull()
    return status_rows.select(
        "*",
        F.when(~known, "starting").when(ok, "ok").otherwise("degraded").alias("state"),
        F.when(known, lag).alias("lag_ledgers"),
        F.when(known, lag * LEDGER_SECONDS).alias("lag_seconds"),
        F.when(known, age).alias("age_seconds"),
        (known & F.coalesce((age <= max_age) & (lag < max_lag), F.lit(False))).alias("ready"),
    )


def plan_start(requests: DataFrame, max_catchup: int = MAX_CATCHUP, lookback: int = LOOKBACK_LEDGERS) -> DataFrame:
    """Where reading starts, and which ledgers are skipped.

    ``requests`` has cursor (null when none), start and tip. ``start_ledger`` is
    null when nothing new is closed. ``gaps`` lists skipped ranges with the
    reason: no longer served, or beyond the catch-up window.
    """
    tip = F.col("tip")
    asked = F.coalesce(F.col("cursor") + 1, F.when(F.col("start") > 0, F.col("start")), tip)
    planned = requests.withColumn("_asked", asked)
    served = planned.withColumn("_served", F.greatest("_asked", tip - lookback))
    final = F.when(tip - F.col("_served") > max_catchup, tip - max_catchup).otherwise(F.col("_served"))
    located = served.withColumn("_final", final)

    def gap(low: str, high: str, reason: str) -> Column:
        return F.when(
            F.col(low) < F.col(high),
            F.struct(F.col(low).alias("from_ledger"), (F.col(high) - 1).alias("to_ledger"), F.lit(reason).alias("reason")),
        )

    gaps = F.array_compact(F.array(gap("_asked", "_served", "retention"), gap("_served", "_final", "catchup")))
    idle = F.col("_asked") > tip
    return located.select(
        *requests.columns,
        F.when(~idle, F.col("_final")).alias("start_ledger"),
        F.when(idle, F.array().cast("array<struct<from_ledger:bigint,to_ledger:bigint,reason:string>>"))
        .otherwise(gaps)
        .alias("gaps"),
    )


def start_gaps(planned: DataFrame) -> DataFrame:
    names = [c for c in planned.columns if c not in ("gaps", "start_ledger")]
    return planned.select(*names, F.explode("gaps").alias("gap")).select(*names, "gap.*")


def trailing(samples: DataFrame, increases: Mapping[str, int] | None = None, deltas: Mapping[str, int] | None = None,
             key: str = "instance", chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Add ``<c>_increase`` / ``<c>_delta`` over trailing windows, {column: seconds}.

    An increase sums steps between neighbouring samples of the window, a drop
    counting as a restart from zero. A series is cut into days; rows near a
    day's end are copied into the next day as its lead-in, so each day is
    complete on its own and no series is ordered whole. Rows keep their day in
    ``_chunk``.
    """
    increases, deltas = increases or {}, deltas or {}
    lead = max([*increases.values(), *deltas.values()])
    # A window longer than a chunk takes chunks of as many days as it needs.
    chunk_seconds *= max(1, -(-lead // chunk_seconds))
    at = F.unix_seconds("at")
    own = F.floor(at / F.lit(chunk_seconds))
    also = F.floor((at + lead) / F.lit(chunk_seconds))
    spread = samples.select("*", at.alias("_t"), own.alias("_own"), F.explode(F.array_distinct(F.array(own, also))).alias("_chunk"))
    ordered = W.partitionBy(key, "_chunk").orderBy("_t")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)

    def step(c: str) -> Column:
        before = F.lag(c).over(ordered)
        return F.when(before.isNull(), 0).when(F.col(c) < before, F.col(c)).otherwise(F.col(c) - before)

    def grown(c: str, seconds: int) -> Column:
        return (F.col(c) - F.first(c).over(ordered.rangeBetween(-seconds, 0)))

    steps = spread.select("*", *[step(c).alias(f"_step_{c}") for c in increases])
    total = steps.select("*", *[F.sum(f"_step_{c}").over(upto).alias(f"_sum_{c}") for c in increases])
    out = total.select(
        *samples.columns,
        "_own",
        "_chunk",
        *[grown(f"_sum_{c}", s).alias(f"{c}_increase") for c, s in increases.items()],
        *[grown(c, s).alias(f"{c}_delta") for c, s in deltas.items()],
    )
    return out.where("_chunk = _own").drop("_own")


def rate(samples: DataFrame, counters: Sequence[str], seconds: int = 300, key: str = "instance") -> DataFrame:
    """Per-second rate of counters over a trailing window, without extrapolation."""
    grown = trailing(samples, increases=dict.fromkeys(counters, seconds), key=key).drop("_chunk")
    return grown.select("*", *[(F.col(f"{c}_increase") / F.lit(float(seconds))).alias(f"{c}_rate") for c in counters])


# Fixed values: (alert, severity, hold in seconds).
ALERTS = (
    ("IndexerLagHigh", "warning", 300),
    ("IndexerLagCritical", "critical", 120),
    ("IndexerStalled", "critical", 300),
    ("IndexerErrorRateHigh", "warning", 120),
    ("LargeLagGrowth", "warning", 300),
    ("IngestRateLow", "warning", 600),
    ("APINoRequests", "warning", 300),
)


def _conditions() -> dict[str, Column]:
    per_second = lambda c: F.col(f"{c}_increase") / F.lit(300.0)
    return {
        "IndexerLagHigh": F.col("lag") > 100,
        "IndexerLagCritical": F.col("lag") > 500,
        "IndexerStalled": (F.col("ingested_increase") == 0) & (F.col("lag") > 0),
        "IndexerErrorRateHigh": (per_second("errors") > 0.01) & (F.col("errors_increase") > 0),
        "LargeLagGrowth": F.col("lag_delta") > 1000,
        "IngestRateLow": per_second("ingested") < 1,
        "APINoRequests": F.col("requests_increase") == 0,
    }


def evaluate_alerts(samples: DataFrame, key: str = "instance") -> DataFrame:
    """(instance, alert, severity, started_at, fired_at, ended_at).

    ``samples`` has instance, at, the counters ingested, errors and requests
    and the gauge lag. A rule fires once its condition has held from sample to
    sample for its hold time.
    """
    grown = trailing(samples, dict.fromkeys(("ingested", "errors", "requests"), 300), {"lag": 3600}, key)
    tests = _conditions()
    rules = F.array(
        *[
            F.struct(F.lit(a).alias("alert"), F.lit(s).alias("severity"), F.lit(h).alias("hold"), F.coalesce(tests[a], F.lit(False)).alias("on"))
            for a, s, h in ALERTS
        ]
    )
    rows = grown.select(key, "_chunk", "at", F.explode(rules).alias("r")).select(key, "_chunk", "at", "r.*")
    # Runs of equal truth inside each day, on the placement the samples already have.
    day = [key, "_chunk", "alert"]
    changed = lambda order: (~F.col("on").eqNullSafe(F.lag("on").over(order))).cast("int")
    inside = W.partitionBy(*day).orderBy("at")
    marked = rows.withColumn("_new", changed(inside))
    local = marked.withColumn("_run", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = local.groupBy(*day, "severity", "hold", "on", "_run").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"))
    # A few runs per day are left; runs that go on over midnight are joined.
    across = W.partitionBy(key, "alert").orderBy("started_at")
    linked = runs.withColumn("_new", changed(across)).withColumn(
        "_run", F.sum("_new").over(across.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    spans = linked.where("on").groupBy(key, "alert", "severity", "hold", "_run").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")
    )
    fired = F.timestamp_seconds(F.unix_seconds("started_at") + F.col("hold"))
    return spans.where(F.unix_seconds("ended_at") - F.unix_seconds("started_at") >= F.col("hold")).select(
        key, "alert", "severity", "started_at", fired.alias("fired_at"), "ended_at"
    )
