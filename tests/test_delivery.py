import hashlib
import hmac
import os
import random
import zlib
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from eventloom.functions.signing import hmac_pads, hmac_sha256
from eventloom.operators import deliveries as D
from eventloom.operators import matching
from eventloom.sources import queue as buckets

SUBS = "id string, url string, kind string, contract_id string, event_name string, secret string, active boolean, consecutive_failures int"


def subs(spark, *given):
    """given: (id, kind, contract, name, active, failures)"""
    df = spark.createDataFrame([(i, "u", k, c, n, "s", a, f) for i, k, c, n, a, f in given], SUBS)
    return df.withColumn("created_at", F.timestamp_seconds(F.lit(0))).withColumn("auto_disabled_at", F.lit(None).cast("timestamp")).withColumn(
        "auto_disabled_reason", F.lit(None).cast("string")
    )


def test_fan_out_keeps_streams_apart(spark):
    s = subs(spark, ("ev", "event", None, None, True, 0), ("up", "upgrade", None, None, True, 0), ("scoped", "upgrade", "CX", None, True, 0), ("off", "upgrade", None, None, False, 0))
    versions = spark.createDataFrame([(1, "C", 1), (2, "C", 2), (3, "C", 3)], "id long, contract_id string, version int")
    assert rows(matching.match_upgrades(versions, s)) == [("up", 2), ("up", 3)]
    items = spark.createDataFrame([("e1", "C", "mint")], "event_id string, contract_id string, event_name string")
    assert rows(matching.match_events(items, s)) == [("ev", "e1")]


def brute(items, wanted):
    return sorted((s[0], e[0]) for e in items for s in wanted if s[4] and s[1] == "event" and s[2] in (None, e[1]) and s[3] in (None, e[2]))


def test_matches_equal_brute_force_with_and_without_broadcast(spark):
    rnd = random.Random(1)
    # One contract holds most events, and some names are missing.
    items = [(f"e{i}", rnd.choice(["C1"] * 6 + ["C2", "C3"]), rnd.choice(["mint", "burn", None])) for i in range(400)]
    wanted = [(f"s{i}", "event", rnd.choice([None, "C1", "C2", "C9"]), rnd.choice([None, "mint", "burn"]), rnd.random() > 0.2, 0) for i in range(40)]
    df = spark.createDataFrame(items, "event_id string, contract_id string, event_name string")
    want = brute(items, wanted)
    assert rows(matching.match_events(df, subs(spark, *wanted))) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(matching.match_events(df, subs(spark, *wanted))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def queue(spark, *given):
    """given: (id, sub, event, upgrade, status, attempts)"""
    df = spark.createDataFrame(list(given), "id long, subscription_id string, event_id string, upgrade_id long, status string, attempts int")
    t = lambda s: F.timestamp_seconds(F.lit(s))
    return df.withColumn("last_error", F.lit("old")).withColumn("next_attempt_at", t(5)).withColumn("delivered_at", F.lit(None).cast("timestamp")).withColumn("created_at", t(0))


def test_enqueue_is_unique_per_item(spark):
    stored = queue(spark, (1, "s", "e1", None, "failed", 6), (2, "s", None, 7, "pending", 0))
    matches = spark.createDataFrame([("s", "e1", None), ("s", "e2", None), ("s", "e2", None), ("s", None, 7), ("s", None, 8), ("t", "e1", None)],
                                    "subscription_id string, event_id string, upgrade_id long")
    made = D.enqueue(stored, matches, F.timestamp_seconds(F.lit(9)))
    assert rows(made, "subscription_id", "event_id", "upgrade_id", "status", "attempts") == [
        ("s", "e2", None, "pending", 0), ("s", None, 8, "pending", 0), ("t", "e1", None, "pending", 0),
    ]


def test_outcomes(spark):
    stored = queue(spark, (1, "s", "a", None, "pending", 0), (2, "s", "b", None, "pending", 4), (3, "s", "c", None, "pending", 5), (4, "s", "d", None, "pending", 2))
    seen = spark.createDataFrame([(1, True, None), (2, False, "boom"), (3, False, "boom")], "delivery_id long, ok boolean, error string")
    now = F.timestamp_seconds(F.lit(1000))

    def run(**kw):
        out = D.apply_outcomes(stored, seen, now, **kw)
        return {r[0]: r[1:] for r in rows(out, "id", "status", "attempts", "last_error", F.unix_seconds("next_attempt_at"), F.unix_seconds("delivered_at"))}

    top = run(jitter="max")
    assert top[1] == ("delivered", 1, None, 5, 1000)
    assert top[2] == ("pending", 5, "boom", 1032, None)
    assert top[3] == ("failed", 6, "boom", 5, None)
    assert top[4] == ("pending", 2, "old", 5, None)
    assert run(jitter="none")[2][3] == 1000
    drawn = run(jitter="full", seed=3)
    assert drawn == run(jitter="full", seed=3) and 1000 <= drawn[2][3] <= 1032
    assert run(jitter="max", max_attempts=99)[3][3] == 1064


def test_backoff_is_capped(spark):
    stored = queue(spark, (1, "s", "a", None, "pending", 60), (2, "s", "a", None, "pending", 2000))
    seen = spark.createDataFrame([(1, False, "x"), (2, False, "x")], "delivery_id long, ok boolean, error string")
    out = D.apply_outcomes(stored, seen, F.timestamp_seconds(F.lit(0)), max_attempts=9999, jitter="max")
    assert [r[0] for r in rows(out, F.unix_seconds("next_attempt_at"))] == [3600, 3600]


def test_auto_disable_equals_a_plain_loop(spark):
    rnd = random.Random(7)
    start = {"a": 0, "b": 8, "c": 2, "quiet": 3}
    data = []
    for sub, good in (("a", 0.3), ("b", 0.1), ("c", 0.02)):
        data += [(sub, i, rnd.random() < good, rnd.randrange(40) * 1800) for i in range(150)]
    df = spark.createDataFrame(data, "subscription_id string, delivery_id long, ok boolean, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    want = {}
    for sub, n in start.items():
        hit = None
        for _, i, ok, at in sorted((d for d in data if d[0] == sub), key=lambda d: (d[3], d[1])):
            n = 0 if ok else n + 1
            hit = n if hit is None and not ok and n >= 10 else hit
        want[sub] = (n, hit is None, hit and f"Auto-disabled after {hit} consecutive delivery failures")
    s = subs(spark, *[(k, "event", None, None, True, v) for k, v in start.items()])
    got = D.update_subscriptions(s, df, F.timestamp_seconds(F.lit(9)))
    assert {r[0]: r[1:] for r in rows(got, "id", "consecutive_failures", "active", "auto_disabled_reason")} == want


def test_redrive_and_reenable(spark):
    q = queue(spark, (1, "s", "a", None, "failed", 6), (2, "s", "b", None, "pending", 1), (3, "t", "c", None, "failed", 6))
    assert rows(D.redrive(q, "s", F.timestamp_seconds(F.lit(9))), "id", "status", "attempts", "last_error") == [
        (1, "pending", 0, None), (2, "pending", 1, "old"), (3, "failed", 6, "old"),
    ]
    assert D.redrive(q, "s", F.timestamp_seconds(F.lit(9)), F.timestamp_seconds(F.lit(1))).where("id = 1").first()["status"] == "failed"
    s = subs(spark, ("a", "event", None, None, False, 12), ("b", "event", None, None, False, 12))
    off = s.withColumn("auto_disabled_at", F.when(F.col("id") == "a", F.timestamp_seconds(F.lit(1))))
    assert rows(D.reenable(D.reenable(off, "a"), "b"), "id", "active", "consecutive_failures") == [("a", True, 0), ("b", False, 12)]
    assert "secret" not in D.list_subscriptions(s).columns


def test_checks(spark):
    df = spark.createDataFrame([("1", "event", None, None), ("2", "x", None, None), ("3", "upgrade", None, "mint"), ("4", "event", "", None), ("5", None, None, None), ("6", "upgrade", "C", None)],
                               "id string, kind string, contract_id string, event_name string")
    ok, bad = D.check_subscriptions(df)
    assert [r[0] for r in rows(ok, "id")] == ["1", "6"] and [r[0] for r in rows(bad, "id")] == ["2", "3", "4", "5"]


def test_hmac(spark):
    data = [("k", "hi"), ("", ""), ("x" * 64, "body"), ("é" * 80, "ünï"), ("s", '{"type":"contract.upgraded"}')]
    df = spark.createDataFrame(data, "secret string, m string")
    got = dict(rows(df.select("m", hmac_sha256(hmac_pads(F.col("secret")), F.col("m")))))
    assert got == {m: hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in data}
    signed = D.sign(df.withColumnRenamed("m", "payload"))
    assert signed.where("secret = 's'").first()["event_header"] == "contract.upgraded"
    assert signed.where("secret = 'k'").first()["event_header"] == "contract.event"
    assert signed.where("secret = 'k'").first()["signature"].startswith("sha256=")


QUEUE = "id string, attempts int, status string, last_error string, next_attempt_at timestamp, delivered_at timestamp"


def test_bucketed_rounds_equal_the_whole_table(spark, folder):
    """Six rounds, one of them run twice: the deliveries of transitions of the whole table, and earlier folders stay as they are."""
    rng = random.Random(6)
    given = [(f"d{i}", rng.randrange(6), "pending" if i % 9 else "failed", None, datetime.fromtimestamp(1_000_000 + rng.randrange(600)), None) for i in range(120)]
    whole = spark.createDataFrame(given, QUEUE)
    base, position, state = f"{folder}/q", 0, {r.id: r for r in whole.collect()}
    buckets.put(whole, base, 0, position)
    for number in range(1, 7):
        now_s = 1_000_000 + number * 130
        now, upto = F.timestamp_seconds(F.lit(now_s)), now_s // buckets.BUCKET_SECONDS
        want = sorted(i for i, r in state.items() if r.status == "pending" and r.next_attempt_at.timestamp() // buckets.BUCKET_SECONDS < upto)
        told = [(i, zlib.crc32(f"{i}-{number}".encode()) % 10 < 3, "e") for i in want if int(i[1:]) % 5]
        outcomes = spark.createDataFrame(told, "delivery_id string, ok boolean, error string")
        files = {os.path.join(d, f) for d, _, names in os.walk(base) for f in names}
        times = {f: os.path.getmtime(f) for f in files}
        for _ in range(2 if number == 3 else 1):
            taken = buckets.due(spark, base, whole.schema, number, position, upto)
            assert sorted(r.id for r in taken.collect()) == want
            assert "due_bucket" in taken._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
            buckets.settle(taken, outcomes, base, now, number, upto, jitter="max")
        assert {f: os.path.getmtime(f) for f in files} == times
        moved = D.apply_outcomes(spark.createDataFrame(list(state.values()), QUEUE), outcomes, now, jitter="max")
        state, position = {r.id: r for r in moved.collect()}, upto
        assert {r.id: r for r in buckets.deliveries(spark, base, whole.schema, position).collect()} == state
    assert {r.status for r in state.values()} == {"pending", "failed", "delivered"}
    assert buckets.due(spark, f"{folder}/none", whole.schema, 1, 0, 9).count() == 0
