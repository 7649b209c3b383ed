import random

from conftest import rows
from pyspark.sql import functions as F

from eventloom.operators import monitor
from eventloom.operators.ordered import with_previous, with_running_sums


def test_chunked_windows_equal_plain_ones(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("aaab"), i, rnd.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    want_prev, want_sum, last, total = {}, {}, {}, {}
    for k, t, v in data:
        want_prev[t], last[k] = last.get(k), v
        total[k] = want_sum[t] = total.get(k, 0) + v
    for width in (1, 7, 1000):
        chunk = F.floor(F.col("t") / width)
        assert dict(rows(with_previous(df, ["k"], ["t"], chunk, {"p": "v"}), "t", "p")) == want_prev
        assert dict(rows(with_running_sums(df, ["k"], ["t"], chunk, {"s": "v"}), "t", "s")) == want_sum


def samples(spark, given):
    """given: (instance, t, ingested, errors, requests, lag)"""
    df = spark.createDataFrame(given, "instance string, t long, ingested long, errors long, requests long, lag long")
    return df.select("instance", F.timestamp_seconds("t").alias("at"), "ingested", "errors", "requests", "lag")


def test_rates_across_days_and_resets(spark):
    # The series crosses midnight and the counter restarts once.
    data = [("i", 86_400 * d + s, v, 0, 0, 0) for d, s, v in ((0, 86_100, 10), (0, 86_340, 40), (1, 0, 70), (1, 60, 5), (1, 400, 8))]
    got = monitor.rate(samples(spark, data), ["ingested"])
    assert [r[1] for r in rows(got.select(F.unix_seconds("at"), "ingested_increase"))] == [0, 30, 60, 35, 0]
    assert rows(got, "ingested_rate")[0][0] == 0.0


def test_alert_holds_over_midnight(spark):
    flat = [("i", 86_000 + 60 * k, 10 ** 6 + 1000 * k, 0, 50 * k, 150 if 2 <= k <= 9 else 0) for k in range(14)]
    got = monitor.evaluate_alerts(samples(spark, flat))
    lag = rows(got.where("alert = 'IndexerLagHigh'").select(F.unix_seconds("started_at"), F.unix_seconds("fired_at"), F.unix_seconds("ended_at")))
    assert lag == [(86_120, 86_420, 86_540)]
    short = [("i", 60 * k, 0, 0, 0, 600 if k in (1, 2, 5, 6, 7) else 0) for k in range(10)]
    got = monitor.evaluate_alerts(samples(spark, short)).where("alert = 'IndexerLagCritical'")
    assert rows(got.select(F.unix_seconds("started_at"), F.unix_seconds("ended_at"))) == [(300, 420)]


def test_start_rules(spark):
    df = spark.createDataFrame(
        [(1, 999_990, 0, 1_000_000), (2, None, 0, 1_000_000), (3, None, 500, 1_000_000), (4, 1_000_000, 0, 1_000_000), (5, 990_000, 0, 1_000_000), (6, None, 10, 1_000_000)],
        "id int, cursor long, start long, tip long",
    )
    planned = monitor.plan_start(df, max_catchup=10**9)
    assert dict(rows(planned, "id", "start_ledger")) == {1: 999_991, 2: 1_000_000, 3: 880_000, 4: None, 5: 990_001, 6: 880_000}
    gaps = monitor.start_gaps(monitor.plan_start(df))
    assert rows(gaps, "id", "from_ledger", "to_ledger", "reason") == [
        (3, 500, 879_999, "retention"), (3, 880_000, 995_999, "catchup"), (5, 990_001, 995_999, "catchup"), (6, 10, 879_999, "retention"), (6, 880_000, 995_999, "catchup"),
    ]


def test_health(spark):
    df = spark.createDataFrame([(100, 150, 1000), (100, 200, 1000), (100, 90, 879), (100, 90, 880), (None, 5, 1000)], "last_processed_ledger long, chain_tip_ledger long, s long")
    got = monitor.health(df.withColumn("updated_at", F.timestamp_seconds("s")), F.timestamp_seconds(F.lit(1000)))
    assert [(r["state"], r["lag_ledgers"], r["ready"]) for r in got.collect()] == [
        ("ok", 50, True), ("degraded", 100, False), ("degraded", 0, False), ("ok", 0, True), ("starting", None, False),
    ]


def test_status_needs_no_events(spark):
    names = ", ".join(f"{c} long" for c in monitor.CYCLE_SUMS)
    df = spark.createDataFrame([(1, 5, 6, *[1] * 8), (2, 9, 9, *[2] * 8)], f"cycle_id long, last_ledger long, tip_ledger long, {names}")
    row = monitor.status(df.withColumn("at", F.timestamp_seconds("cycle_id"))).first()
    assert (row["last_processed_ledger"], row["chain_tip_ledger"], row["ingested_total"], row["rpc_errors_total"]) == (9, 9, 3, 3)


def test_windows_longer_than_a_chunk(spark):
    data = [("i", 50_000 * k, 10 * k, 0, 0, 0) for k in range(12)]
    got = monitor.trailing(samples(spark, data), increases={"ingested": 200_000})
    want = [10 * min(k, 4) for k in range(12)]
    assert [v for _, v in sorted(rows(got.select(F.unix_seconds("at"), "ingested_increase")))] == want
