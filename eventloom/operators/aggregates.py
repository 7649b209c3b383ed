"""Counts and summaries. Every aggregate combines map-side before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.reads import _span, matching

BUCKETS = ("hour", "day", "ledger")
BUCKET_TEXT = "yyyy-MM-dd HH:mm:ssx"
PERCENTILES = (50, 95, 99)


def contract_summaries(ev: DataFrame) -> DataFrame:
    return ev.groupBy("contract_id").agg(
        F.count("*").alias("event_count"),
        F.min("ledger").alias("first_seen_ledger"),
        F.max("ledger").alias("last_seen_ledger"),
    )


def merge_summaries(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold new events into stored summaries."""
    return (
        stored.select("contract_id", "event_count", "first_seen_ledger", "last_seen_ledger")
        .unionByName(contract_summaries(batch))
        .groupBy("contract_id")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.min("first_seen_ledger").alias("first_seen_ledger"),
            F.max("last_seen_ledger").alias("last_seen_ledger"),
        )
    )


def bucket_of(bucket: str) -> Column:
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}")
    return F.col("ledger") if bucket == "ledger" else F.date_trunc(bucket, "ledger_closed_at")


def _bucket_text(bucket: str) -> Column:
    key = F.col("_bucket")
    return key.cast("string") if bucket == "ledger" else F.date_format(key, BUCKET_TEXT)


def _in_range(ev: DataFrame, contract_id: str | None, bucket: str, from_, to) -> DataFrame:
    column = "ledger" if bucket == "ledger" else "ledger_closed_at"
    return _span(matching(ev, contract_id=contract_id), column, from_, to)


def stats_long(ev: DataFrame, contract_id: str | None, bucket: str, from_=None, to=None) -> DataFrame:
    """(bucket, event_name, n); unnamed events keep a null name."""
    found = _in_range(ev, contract_id, bucket, from_, to)
    counted = found.groupBy(bucket_of(bucket).alias("_bucket"), "event_name").agg(F.count("*").alias("n"))
    return counted.select(_bucket_text(bucket).alias("bucket"), "event_name", "n")


def contract_stats(ev: DataFrame, contract_id: str | None, bucket: str = "day", from_=None, to=None,
                   group_by: str | None = None) -> DataFrame:
    """Event count per bucket, newest first; grouped adds a name -> count map.

    Unnamed events count in the total but not in the map; an empty map is null.
    """
    if group_by not in (None, "event_name"):
        raise ValueError("only group_by='event_name' is supported")
    found = _in_range(ev, contract_id, bucket, from_, to)
    key = bucket_of(bucket).alias("_bucket")
    if group_by is None:
        counted = found.groupBy(key).agg(F.count("*").alias("count"))
        return counted.orderBy(F.col("_bucket").desc()).select(_bucket_text(bucket).alias("bucket"), "count")
    named = found.groupBy(key, "event_name").agg(F.count("*").alias("n"))
    # One entry per distinct name of a bucket.
    entry = F.when(F.col("event_name").isNotNull(), F.struct("event_name", "n"))
    counted = named.groupBy("_bucket").agg(
        F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("breakdown")
    )
    return counted.orderBy(F.col("_bucket").desc()).select(
        _bucket_text(bucket).alias("bucket"),
        "count",
        F.when(F.size("breakdown") > 0, F.col("breakdown")).alias("breakdown"),
    )


def stats_total(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def enrichment_coverage(ev: DataFrame, *keys: str) -> DataFrame:
    """Named records versus plain ones, overall or per key."""
    done = F.count_if(F.col("enriched").isNotNull())
    return ev.groupBy(*keys).agg(
        done.alias("enriched"),
        F.count_if(F.col("enriched").isNull()).alias("not_enriched"),
        F.try_divide(done, F.count("*")).alias("rate"),
    )


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("subscription_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "failed", "pending")]
    )


def newest_deliveries(deliveries: DataFrame, per_subscription: int = 50) -> DataFrame:
    """Newest deliveries of each subscription.

    The rank limit is applied map-side before the shuffle, so a busy
    subscription sends at most that many rows per task.
    """
    newest = W.partitionBy("subscription_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return deliveries.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= per_subscription).drop("_rank")


def delivery_history(deliveries: DataFrame, subscription_id: str) -> tuple[DataFrame, DataFrame]:
    """(counts, 50 newest deliveries) of one subscription."""
    mine = matching(deliveries, subscription_id=subscription_id)
    return delivery_summary(mine), mine.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)


def delivery_health(deliveries: DataFrame, now: Column) -> DataFrame:
    """Queue health in one pass. Recent failures go by creation time."""
    status = F.col("status")
    recent = now - F.expr("interval 1 minute")
    oldest = F.min(F.when(status == "pending", F.col("created_at")))
    return deliveries.agg(
        F.count_if(status == "pending").alias("pending"),
        oldest.alias("_oldest"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "delivered").alias("delivered"),
        F.count_if((status == "delivered") & (F.col("delivered_at") >= recent)).alias("delivered_last_minute"),
        F.count_if((status == "failed") & (F.col("created_at") >= recent)).alias("failed_last_minute"),
    ).select(
        "pending",
        F.coalesce(F.unix_seconds(now) - F.unix_seconds("_oldest"), F.lit(0)).alias("oldest_pending_age_s"),
        "failed", "delivered", "delivered_last_minute", "failed_last_minute",
    )


def upgrade_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("contract_id").agg(
        F.count_if(F.col("version") > 1).alias("upgrades"), F.count_if(F.col("breaking")).alias("breaking_versions")
    )


def route_template(path: Column) -> Column:
    """Path with UUID-like and integer segments replaced by ``{id}``."""

    def segment(s: Column) -> Column:
        dashes = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
        uuid_like = (F.octet_length(s) == 36) & (dashes == 4)
        integer = s.rlike(r"\A[+-]?[0-9]+\z") & s.try_cast("bigint").isNotNull()
        return F.when(uuid_like | F.coalesce(integer, F.lit(False)), F.lit("{id}")).otherwise(s)

    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, segment), "/"))


def route_stats(log: DataFrame) -> DataFrame:
    """Per (route, method): count, sum and exact nearest-rank percentiles.

    Requests are first reduced to counts per distinct latency, so the ordered
    step works on latencies in milliseconds rather than on requests.
    """
    keys = ["route", "method"]
    counts = log.groupBy(route_template(F.col("path")).alias("route"), "method", "latency_ms").agg(F.count("*").alias("n"))
    upto = W.partitionBy(*keys).orderBy("latency_ms").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.select("*", F.sum("n").over(upto).alias("_upto"), F.sum("n").over(W.partitionBy(*keys)).alias("_all"))

    def at(p: int) -> Column:
        # Smallest latency whose rank reaches ceil(n * p / 100), in integers.
        need = F.ceil(F.col("_all") * p / F.lit(100))
        return F.min(F.when(F.col("_upto") >= need, F.col("latency_ms"))).alias(f"p{p}")

    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.sum(F.col("n") * F.col("latency_ms")).alias("sum_ms"),
        *[at(p) for p in PERCENTILES],
    )


def route_status(log: DataFrame) -> DataFrame:
    return log.groupBy(route_template(F.col("path")).alias("route"), "method", "status").agg(F.count("*").alias("count"))
