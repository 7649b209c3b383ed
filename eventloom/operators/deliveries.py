"""The delivery queue as table transitions.

Sending is outside; its results come back as an outcomes table
(delivery_id, ok, error, at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.once import computed_once
from eventloom.functions.jsontext import iso_text
from eventloom.functions.signing import hmac_pads, hmac_sha256
from eventloom.operators.reads import event_json
from eventloom.plans.joins import lookup_join

MAX_ATTEMPTS, FAILURE_THRESHOLD, MAX_BACKOFF_SECONDS = 6, 10, 3600
UPGRADE_TYPE, EVENT_TYPE = "contract.upgraded", "contract.event"
HOUR_SECONDS = 3600


def _with_both_ids(matches: DataFrame) -> DataFrame:
    for name, kind in (("event_id", "string"), ("upgrade_id", "bigint")):
        if name not in matches.columns:
            matches = matches.withColumn(name, F.lit(None).cast(kind))
    return matches.select("subscription_id", "event_id", "upgrade_id")


def pending(matches: DataFrame, now: Column) -> DataFrame:
    """Pending deliveries of matches; each row becomes one."""
    return _with_both_ids(matches).select(
        "subscription_id", "event_id", "upgrade_id",
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"),
        now.alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("delivered_at"), now.alias("created_at"),
    )


def enqueue(deliveries: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """New pending deliveries for matches not queued yet.

    ``matches`` has subscription_id and event_id or upgrade_id.
    """
    # Exactly one of the two ids is set; a text of it makes an ordinary join key.
    item = F.coalesce(F.concat(F.lit("e:"), F.col("event_id")), F.concat(F.lit("u:"), F.col("upgrade_id").cast("string")))
    new = _with_both_ids(matches).withColumn("_item", item)
    known = deliveries.select("subscription_id", item.alias("_item"))
    # Repeats are dropped among what is new, not among all matches.
    fresh = new.join(known, ["subscription_id", "_item"], "left_anti").select("subscription_id", "event_id", "upgrade_id").distinct()
    return pending(fresh, now)


def _upgrade_json() -> Column:
    return F.to_json(
        F.struct(
            F.col("v.breaking").alias("breaking"),
            F.col("v.contract_id").alias("contract_id"),
            F.try_parse_json("v.diff").alias("diff"),
            iso_text(F.col("v.observed_at")).alias("observed_at"),
            F.col("v.previous_wasm_hash").alias("previous_wasm_hash"),
            F.lit(UPGRADE_TYPE).alias("type"),
            F.col("v.version").alias("version"),
            F.col("v.wasm_hash").alias("wasm_hash"),
        ),
        {"ignoreNullFields": "false"},
    )


def due_deliveries(deliveries: DataFrame, subs: DataFrame, ev: DataFrame, versions: DataFrame, now: Column,
                   limit: int | None = None, with_pads: bool = False) -> DataFrame:
    """Pending deliveries that are due, oldest first, with their payloads.

    The queue is cut to ``limit`` before anything is joined. ``limit`` None
    takes every due row. ``with_pads`` adds each subscription's padded keys,
    worked out once per subscription, for ``sign``.
    """
    due = deliveries.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    due = lookup_join(due, subs.select(F.col("id").alias("subscription_id")), ["subscription_id"], "left_semi")
    if limit is not None:
        due = due.orderBy("next_attempt_at", "id").limit(limit)
    queue = due.select("id", "subscription_id", "event_id", "upgrade_id", "attempts", "next_attempt_at")
    # Events and upgrades are joined apart: in one outer join, all rows without
    # the other kind's id would meet in a single task.
    of_events, of_upgrades = queue.where("upgrade_id is null"), queue.where("upgrade_id is not null")
    # The event table is cut to the queued ids first: a short queue is broadcast
    # to it, so only queued events are rendered and shuffled.
    wanted = lookup_join(ev, of_events.select("event_id").where("event_id is not null"), ["event_id"], "left_semi")
    events = of_events.join(wanted.select("event_id", event_json().alias("payload")), "event_id", "left")
    versioned = versions.select(F.col("id").alias("upgrade_id"), F.struct(*versions.columns).alias("v"))
    upgrades = of_upgrades.join(versioned, "upgrade_id", "left").withColumn("payload", _upgrade_json())
    names = ["id", "subscription_id", "attempts", "next_attempt_at", "payload"]
    targets = subs.select(F.col("id").alias("subscription_id"), "url", "secret")
    if with_pads:
        targets = computed_once(targets, *targets.columns, pads=hmac_pads(F.col("secret")))
    joined = lookup_join(events.select(*names).unionByName(upgrades.select(*names)), targets, ["subscription_id"])
    return joined.select("id", "subscription_id", "attempts", "url", "secret", "next_attempt_at", "payload", *(["pads"] if with_pads else []))


def sign(due: DataFrame) -> DataFrame:
    """Add the signature and event-type headers of each payload, which is parsed once."""
    pads = F.col("pads") if "pads" in due.columns else hmac_pads(F.col("secret"))
    kind = F.try_variant_get(F.try_parse_json("payload"), "$.type", "variant")
    typed = computed_once(due, *due.columns, _kind=kind)
    return typed.select(
        *[c for c in due.columns if c != "pads"],
        F.concat(F.lit("sha256="), hmac_sha256(pads, F.col("payload"))).alias("signature"),
        F.when(F.schema_of_variant("_kind") == "STRING", F.col("_kind").cast("string")).otherwise(EVENT_TYPE).alias("event_header"),
    )


def apply_outcomes(deliveries: DataFrame, outcomes: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS,
                   jitter: str = "full", seed: int = 0) -> DataFrame:
    """Deliveries after one round of sending.

    Failures retry after U(0, min(2^attempts, 3600)) seconds; ``jitter`` may be
    'full', 'none' (now) or 'max' (upper bound). The draw hashes the delivery
    and attempt with the seed, so a retried task repeats it.
    """
    attempts = F.col("attempts") + 1
    bound = F.least(F.pow(F.lit(2.0), attempts), F.lit(float(MAX_BACKOFF_SECONDS))).cast("bigint")
    draws = {
        "none": F.lit(0).cast("bigint"),
        "max": bound,
        "full": F.pmod(F.xxhash64("id", "attempts", F.lit(seed)), bound + 1),
    }
    if jitter not in draws:
        raise ValueError(f"jitter must be one of {sorted(draws)}")
    # A delivery is sent once per round: of repeated outcomes the last one stands.
    told = F.struct(F.col("ok"), F.col("error"))
    last = F.max_by(told, F.struct("at", told)) if "at" in outcomes.columns else F.max(told)
    results = outcomes.groupBy(F.col("delivery_id").alias("id")).agg(last.alias("r")).select("id", F.col("r.ok").alias("_ok"), F.col("r.error").alias("_error"))
    retry_at = now + F.make_dt_interval(secs=draws[jitter])
    sent, ok = F.col("_ok").isNotNull(), F.coalesce(F.col("_ok"), F.lit(False))
    failed = sent & ~ok
    spent = failed & (attempts >= max_attempts)
    changes = {
        "status": F.when(ok, "delivered").when(spent, "failed").otherwise(F.col("status")),
        "attempts": F.when(sent, attempts).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.col("_error")).when(ok, F.lit(None)).otherwise(F.col("last_error")),
        "next_attempt_at": F.when(failed & ~spent, retry_at).otherwise(F.col("next_attempt_at")),
        "delivered_at": F.when(ok, now).otherwise(F.col("delivered_at")),
    }
    joined = deliveries.join(results, "id", "left")
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in deliveries.columns])


def failure_runs(outcomes: DataFrame, start: DataFrame, chunk_seconds: int = HOUR_SECONDS) -> DataFrame:
    """(subscription_id, delivery_id, ok, at, run): failures in a row up to each outcome.

    ``outcomes`` has subscription_id, delivery_id, ok and at; ``start`` gives
    each subscription's count before them. Outcomes are counted inside chunks
    of time; one row per chunk carries the open run to the next.
    """
    order = ("at", "delivery_id")
    names = ("subscription_id", "delivery_id", "ok", "at")
    cut = outcomes.select(*names, F.floor(F.unix_seconds("at") / F.lit(chunk_seconds)).alias("_chunk"))
    cut = cut.repartition("subscription_id", "_chunk")
    inside = W.partitionBy("subscription_id", "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    fails = F.sum((~F.col("ok")).cast("bigint")).over(inside)
    rows = cut.withColumn("_fails", fails).withColumn(
        "_at_success", F.max(F.when(F.col("ok"), F.col("_fails"))).over(inside)
    )
    summary = rows.groupBy("subscription_id", "_chunk").agg(
        F.max("_fails").alias("_all"), F.max("_at_success").alias("_last_success")
    )
    # Open run at the end of a chunk: since its last success, or all of it on
    # top of what came in. Chunks without a success extend the run.
    across = W.partitionBy("subscription_id").orderBy("_chunk")
    upto = across.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    opened = lookup_join(summary, start.select("subscription_id", F.col("consecutive_failures").alias("_start")), ["subscription_id"], "left")
    total = opened.withColumn("_sum", F.sum("_all").over(upto))
    # Total failures of the key at its last success so far.
    base = total.withColumn(
        "_base", F.max(F.when(F.col("_last_success").isNotNull(), F.col("_sum") - F.col("_all") + F.col("_last_success"))).over(earlier)
    )
    carry = base.select(
        "subscription_id",
        "_chunk",
        (F.col("_sum") - F.col("_all") - F.coalesce("_base", -F.coalesce("_start", F.lit(0)))).alias("_carry"),
    )
    joined = rows.join(carry, ["subscription_id", "_chunk"], "left")
    run = F.when(F.col("_at_success").isNull(), F.col("_fails") + F.col("_carry")).otherwise(F.col("_fails") - F.col("_at_success"))
    return joined.select(*names, run.alias("run"))


def update_subscriptions(subs: DataFrame, outcomes: DataFrame, now: Column, threshold: int = FAILURE_THRESHOLD) -> DataFrame:
    """Subscriptions after a batch of outcomes (with their subscription_id).

    A success resets the count, a failure adds one, in (at, delivery_id) order;
    the first outcome that reaches the threshold turns the subscription off.
    """
    start = subs.select(F.col("id").alias("subscription_id"), "consecutive_failures")
    runs = failure_runs(outcomes, start)
    position = F.struct("at", "delivery_id")
    hit = ~F.col("ok") & (F.col("run") >= threshold)
    ended = runs.groupBy("subscription_id").agg(
        F.max_by("run", position).alias("_count"), F.min_by(F.when(hit, F.col("run")), F.when(hit, position)).alias("_hit")
    )
    off = F.col("_hit").isNotNull()
    reason = F.concat(F.lit("Auto-disabled after "), F.col("_hit").cast("string"), F.lit(" consecutive delivery failures"))
    changes = {
        "consecutive_failures": F.coalesce(F.col("_count").cast("int"), F.col("consecutive_failures")),
        "active": F.col("active") & ~off,
        "auto_disabled_at": F.when(off, now).otherwise(F.col("auto_disabled_at")),
        "auto_disabled_reason": F.when(off, reason).otherwise(F.col("auto_disabled_reason")),
    }
    joined = subs.join(ended.withColumnRenamed("subscription_id", "id"), "id", "left")
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in subs.columns])


def redrive(deliveries: DataFrame, subscription_id: str, now: Column, since: Column | None = None) -> DataFrame:
    """Failed deliveries of a subscription back to pending and due now."""
    again = (F.col("subscription_id") == subscription_id) & (F.col("status") == "failed")
    if since is not None:
        again = again & (F.col("created_at") >= since)
    changes = {
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "attempts": F.when(again, 0).otherwise(F.col("attempts")),
        "next_attempt_at": F.when(again, now).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(~again, F.col("last_error")),
    }
    return deliveries.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in deliveries.columns])


def reenable(subs: DataFrame, subscription_id: str) -> DataFrame:
    """An auto-disabled subscription back on; any other row is untouched."""
    again = (F.col("id") == subscription_id) & F.col("auto_disabled_at").isNotNull()
    changes = {
        "active": F.col("active") | again,
        "auto_disabled_at": F.when(~again, F.col("auto_disabled_at")),
        "auto_disabled_reason": F.when(~again, F.col("auto_disabled_reason")),
        "consecutive_failures": F.when(again, 0).otherwise(F.col("consecutive_failures")),
    }
    return subs.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in subs.columns])


def list_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.drop("secret").orderBy(F.col("created_at").desc(), "id")


def check_subscriptions(subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reason)."""
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("event", "upgrade"), F.lit(False)), "kind must be event or upgrade")
        .when((F.col("kind") == "upgrade") & F.col("event_name").isNotNull(), "upgrade takes no event_name")
        .when(F.col("contract_id") == "", "contract_id must not be empty")
    )
    checked = subs.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")
