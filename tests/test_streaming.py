import json
import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F
from wirebuild import account, b64, event, i128, symbol

from eventloom.operators import interfaces as I
from eventloom.operators.aggregates import contract_summaries
from eventloom.plans import mapping as M
from eventloom.schemas import QUEUED
from eventloom.streaming import ingest, live, tables


def page(*events):
    return json.dumps({"latestLedger": 600, "events": list(events)})


def entry(i, ledger, name="mint", amount=5, contract="C1"):
    return {"type": "contract", "ledger": ledger, "ledgerClosedAt": "2024-01-01T00:00:00Z", "contractId": contract, "id": i, "inSuccessfulContractCall": True,
            "txHash": "tx", "topic": [b64(symbol(name)), b64(account(1))], "value": b64(i128(amount))}


def land(folder, name, *events):
    os.makedirs(f"{folder}/pages", exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(page(*events) + "\n")
    os.rename(f"{folder}/{name}", f"{folder}/pages/{name}")


def follow(spark, folder, **kwargs):
    ingest.start_ingest(spark, f"{folder}/pages", f"{folder}/out", f"{folder}/ckpt", max_files=1, **kwargs).awaitTermination()


def test_pages_are_stored_once_over_restarts(spark, folder):
    land(folder, "1.json", entry("e1", 500), entry("e2", 500, "swap"))
    land(folder, "2.json", entry("e3", 501, contract="C2"), entry("e1", 500))
    follow(spark, folder)
    land(folder, "3.json", entry("e1", 500), entry("e2", 500, "swap"), entry("e3", 501, contract="C2"))
    land(folder, "4.json")
    follow(spark, folder)
    out = f"{folder}/out"
    ev = ingest.committed_events(spark, out)
    assert rows(ev, "event_id") == [("e1",), ("e2",), ("e3",)]
    assert rows(ingest.committed_summaries(spark, out)) == rows(contract_summaries(ev))
    transfers = ingest.committed_rows(spark, out, "token_transfers")
    assert rows(transfers, "event_id", "kind", "amount") == [("e1", "mint", "5"), ("e3", "mint", "5")]


def test_a_replayed_batch_changes_nothing(spark, folder):
    land(folder, "1.json", entry("e1", 500))
    follow(spark, folder)
    out = f"{folder}/out"
    from eventloom.sources.pages import read_pages

    raw = read_pages(spark, f"{folder}/pages")
    before = rows(ingest.committed_events(spark, out))
    for _ in range(2):
        ingest.ingest_batch(raw, 0, out)
    assert rows(ingest.committed_events(spark, out)) == before
    assert ingest.committed_summaries(spark, out).first()["event_count"] == 1


def test_unfinished_batch_is_invisible(spark, folder, monkeypatch):
    land(folder, "1.json", entry("e1", 500))
    follow(spark, folder)
    land(folder, "2.json", entry("e2", 501))
    out = f"{folder}/out"
    from eventloom.sources.pages import read_pages

    put = tables.put

    def lost_at_the_end(df, base, table, *rest, **by):
        if table == ingest.CYCLES:
            raise RuntimeError("lost")
        put(df, base, table, *rest, **by)

    with monkeypatch.context() as m:
        m.setattr(tables, "put", lost_at_the_end)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(read_pages(spark, f"{folder}/pages"), 1, out)
    assert rows(ingest.committed_events(spark, out), "event_id") == [("e1",)]
    assert ingest.committed_summaries(spark, out).first()["event_count"] == 1
    ingest.ingest_batch(read_pages(spark, f"{folder}/pages"), 1, out)
    assert rows(ingest.committed_events(spark, out), "event_id") == [("e1",), ("e2",)]


def test_changed_content_of_recent_ledgers(spark, folder):
    land(folder, "1.json", entry("e1", 500), entry("e0", 100))
    follow(spark, folder, reorg_ledgers=50)
    land(folder, "2.json", entry("e1", 500, amount=9), entry("e0", 100, amount=9), entry("e2", 501))
    follow(spark, folder, reorg_ledgers=50)
    got = rows(ingest.committed_events(spark, f"{folder}/out"), "event_id", "decoded_value")
    assert got == [("e0", '"5"'), ("e1", '"9"'), ("e2", '"5"')]


def test_content_that_changes_back_shows_the_last_reading(spark, folder):
    """Change, repeat, change back: one revision per real change."""
    for k, amount in enumerate((5, 9, 9, 5)):
        land(folder, f"{k}.json", entry("e1", 500, amount=amount))
        follow(spark, folder, reorg_ledgers=50)
        assert rows(ingest.committed_events(spark, f"{folder}/out"), "decoded_value") == [(f'"{amount}"',)]
    changes = tables.stored(spark, f"{folder}/out", "revisions", ingest.STORED)
    assert rows(changes, "decoded_value", "batch") == [('"5"', 3), ('"9"', 1)]


def test_a_replay_replaces_all_its_rows(spark, folder):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for by in ([], ["b"]):
        name = f"t{len(by)}"
        tables.put(df, folder, name, 0, by)
        tables.put(df.limit(0), folder, name, 0, by)
        assert tables.stored(spark, folder, name, df.schema).count() == 0


def test_compaction_keeps_what_readers_see(spark, folder):
    """The stream goes on from the compacted store; the old one stays readable."""
    out = f"{folder}/out"
    for k in range(6):
        land(folder, f"{k}.json", entry(f"e{k}", 500 + k), entry("e0", 500, amount=5 + k % 2), entry(f"s{k}", 20_000 + k, "swap"))
        if k in (2, 4):
            held = ingest.committed_events(spark, out)
            before = rows(held)
            ingest.compact(spark, out, f"{folder}/out{k}")
            assert rows(ingest.committed_events(spark, f"{folder}/out{k}")) == before == rows(held)
            assert spark.read.parquet(f"{folder}/out{k}/contract_summaries").count() == 1
            out = f"{folder}/out{k}"
        ingest.start_ingest(spark, f"{folder}/pages", out, f"{folder}/ckpt", max_files=1, reorg_ledgers=30_000).awaitTermination()
    ev = ingest.committed_events(spark, out)
    assert rows(ev, "event_id", "decoded_value")[0] == ("e0", '"6"') and ev.count() == 12
    assert rows(ingest.committed_summaries(spark, out)) == rows(contract_summaries(ev))
    assert ingest.committed_rows(spark, out, "token_transfers").count() == 6
    assert rows(ingest.committed_events(spark, out, 20_002, 20_003), "event_id") == [("s2",), ("s3",)]
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/cycles").select("batch").collect()) == [3, 4, 5]
    ingest.compact(spark, f"{folder}/none", f"{folder}/nothing")
    assert ingest.committed_events(spark, f"{folder}/nothing").count() == 0


def test_compaction_leaves_old_ledgers_behind(spark, folder):
    out, kept = f"{folder}/out", f"{folder}/kept"
    width = ingest.LEDGERS_PER_BUCKET
    land(folder, "1.json", entry("a", 5), entry("b", width - 1), entry("c", width), entry("d", 3 * width))
    follow(spark, folder)
    ingest.compact(spark, out, kept, first_ledger=width)
    assert rows(ingest.committed_events(spark, kept), "event_id") == [("c",), ("d",)]
    assert rows(ingest.committed_rows(spark, kept, "token_transfers"), "event_id") == [("c",), ("d",)]
    assert ingest.committed_summaries(spark, kept).first()["event_count"] == 4  # lifetime
    assert sorted(f for f in os.listdir(f"{kept}/events/batch=0") if f.startswith("ledger")) == ["ledger_bucket=1", "ledger_bucket=3"]


def test_ingest_enriches(spark, folder):
    section = event("mint", [("to", "Address", "topic"), ("amount", "i128", "data")])
    known = I.with_interface(spark.createDataFrame([("C1", bytearray(section))], "contract_id string, section binary")).select("contract_id", "interface")
    land(folder, "1.json", entry("e1", 500), entry("e2", 500, contract="C2"))
    follow(spark, folder, interfaces=known)
    got = {r["event_id"]: r["enriched"] for r in ingest.committed_events(spark, f"{folder}/out").collect()}
    assert json.loads(got["e1"])["params"]["amount"] == {"type": "i128", "value": "5"} and got["e2"] is None


SF = "/root/testdata/sf0.001"


def shuffles_left(spark, before):
    """Shuffle files that are there and were not before; they are removed in the background."""
    for _ in range(20):
        found = {f"{d}/{f}" for d, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_")}
        if found <= before:
            return set()
        time.sleep(0.5)
    return found - before


def test_batches_and_compaction_leave_no_shuffle_files(spark, folder):
    raw = M.raw(spark, SF)
    old = raw.where("event_id < '000000000700'")
    before = shuffles_left(spark, set())
    ingest.ingest_batch(old.unionByName(old), 0, f"{folder}/out", reorg_ledgers=600_000)
    ingest.ingest_batch(raw.withColumn("value", F.lit("AAAAAwAAAAc=")), 1, f"{folder}/out", reorg_ledgers=600_000)
    ingest.compact(spark, f"{folder}/out", f"{folder}/new")
    assert not shuffles_left(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert ingest.committed_events(spark, f"{folder}/new").count() == 1000
    # The decoded batch is not kept beside the tables.
    assert spark.read.schema("event_id string").parquet(f"{folder}/out/staging").count() == 0


def test_large_batches_are_stored_in_slices(spark, folder, monkeypatch):
    """The same tables, whatever is shuffled at once; a replay leaves nothing of the slices of an earlier attempt."""
    raw = M.raw(spark, SF)
    n = F.col("event_id").cast("bigint")
    other = raw.where(n % 3 == 0).withColumn("value", F.lit("AAAAAwAAAAc="))
    written = []
    plain = ingest.clustered

    def tables_of(out, target):
        for k, batch in enumerate((raw.where(n < 600).unionByName(other.where(n < 50)), raw.unionByName(raw).unionByName(other), other)):
            ingest.ingest_batch(batch, k, out, reorg_ledgers=600_000)
        ingest.compact(spark, out, target)
        return [rows(f(spark, o)) for o in (out, target) for f in (ingest.committed_events, ingest.committed_summaries, lambda *a: ingest.committed_rows(*a, "token_transfers"))]

    want = tables_of(f"{folder}/whole", f"{folder}/whole2")
    monkeypatch.setattr(ingest, "SLICE_ROWS", 400)
    monkeypatch.setattr(ingest, "clustered", lambda df: written.append(df) or plain(df))
    with monkeypatch.context() as m:
        put, calls = tables.put, []

        def lost(*args, **kwargs):
            calls.append(args)
            if len(calls) == 3:
                raise RuntimeError("lost")
            put(*args, **kwargs)

        m.setattr(tables, "put", lost)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(raw, 0, f"{folder}/cut")
    del written[:]
    assert tables_of(f"{folder}/cut", f"{folder}/cut2") == want
    assert len(want[0]) == 1000 and want[0] == want[3]
    # Slices of 617, 2,334 and 334 rows in the batches, then of 1,000 events in the compaction.
    assert len(written) >= 2 + 6 + 1 + 3 and all(df.count() < 500 for df in written[9:12])


def test_events_without_revisions_are_not_joined(spark, folder):
    land(folder, "1.json", entry("e1", 500))
    follow(spark, folder, reorg_ledgers=50)
    found = ingest.committed_events(spark, f"{folder}/out")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1


def file_stream(spark, folder, df, name):
    df.write.parquet(f"{folder}/{name}")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")


SUBS = "id string, kind string, contract_id string, event_name string, active boolean"


def queued(spark, folder, name):
    return rows(tables.stored(spark, f"{folder}/out/{name}", "deliveries", QUEUED), "subscription_id", "event_id", "upgrade_id")


def test_fan_out_has_own_positions(spark, folder):
    subs = spark.createDataFrame([("s1", "event", None, "mint", True), ("s2", "upgrade", "C", None, True)], SUBS)
    ev = file_stream(spark, folder, spark.createDataFrame([("e1", "C", "mint"), ("e2", "C", None)], "event_id string, contract_id string, event_name string"), "ev")
    up = file_stream(spark, folder, spark.createDataFrame([(1, "C", 1), (2, "C", 2)], "id long, contract_id string, version int"), "up")

    def run():
        for q in live.start_fanout(ev, up, lambda: subs, f"{folder}/out", f"{folder}/ckpt"):
            q.awaitTermination()

    run()
    spark.createDataFrame([("e1", "C", "mint"), ("e3", "D", "mint")], ev.schema).write.mode("append").parquet(f"{folder}/ev")
    run()
    assert [queued(spark, folder, n) for n in ("events", "upgrades")] == [[("s1", "e1", None), ("s1", "e3", None)], [("s2", None, 2)]]


def test_fan_out_over_many_batches_and_restarts(spark, folder):
    """Repeats in a batch, across batches and across restarts are queued once; a new subscription sees only what comes later; a batch does not slow down."""
    shape = "event_id string, contract_id string, event_name string"
    none = file_stream(spark, folder, spark.createDataFrame([], "id long, contract_id string, version int"), "up")
    spark.createDataFrame([], shape).write.parquet(f"{folder}/ev")
    subs = [("s1", "event", None, None, True)]
    took, batches = [], 50
    for start in range(0, batches, 25):
        for k in range(start, start + 25):
            given = [(f"e{k}-{i}", "C", "mint") for i in range(20)] * 2 + [(f"e{max(0, k - 3)}-{i}", "C", "mint") for i in range(20)]
            spark.createDataFrame(given, shape).coalesce(1).write.mode("append").parquet(f"{folder}/ev")
        ev = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ev")
        queries = live.start_fanout(ev, none, lambda: spark.createDataFrame(subs, SUBS), f"{folder}/out", f"{folder}/ckpt")
        for q in queries:
            q.awaitTermination()
        took += [p.durationMs["triggerExecution"] for p in queries[0].recentProgress if p.numInputRows]
        subs.append(("s2", "event", None, None, True))
    want = [("s1", f"e{k}-{i}", None) for k in range(batches) for i in range(20)] + [("s2", f"e{k}-{i}", None) for k in range(25, batches) for i in range(20)]
    assert queued(spark, folder, "events") == sorted(want, key=repr)
    assert len(took) >= batches
    assert sorted(took[-15:])[7] < 2 * sorted(took[5:20])[7] + 500


def test_first_seen_keeps_old_rows_and_forgets_after_a_while(spark, folder):
    df = spark.createDataFrame([("a", 5), ("b", 1)], "k string, v long")
    src = file_stream(spark, folder, df, "in")

    def run(kept_for):
        q = live.first_seen(src, ["k"], kept_for).writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/c")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.k for r in spark.read.parquet(f"{folder}/o").collect())

    assert run("1 second") == ["a", "b"]
    df.write.mode("append").parquet(f"{folder}/in")
    time.sleep(3)
    spark.createDataFrame([("c", 0)], df.schema).write.mode("append").parquet(f"{folder}/in")
    got = run("1 second")
    assert got[-1] == "c" and set(got) == {"a", "b", "c"}


def test_summaries_and_stats_equal_batch(spark, folder):
    data = [(f"e{i}", f"C{i % 3}", i * 100, "mint") for i in range(50)]
    df = spark.createDataFrame(data, "event_id string, contract_id string, ledger long, event_name string").withColumn("ledger_closed_at", F.timestamp_seconds(F.col("ledger") * 5))
    src = file_stream(spark, folder, df, "ev")
    live.start_updates(live.summaries_stream(src), f"{folder}/s", "t", f"{folder}/c1").awaitTermination()
    more = df.withColumn("event_id", F.concat("event_id", F.lit("x")))
    more.write.mode("append").parquet(f"{folder}/ev")
    q = live.summaries_stream(src)
    live.start_updates(q, f"{folder}/s", "t", f"{folder}/c1").awaitTermination()
    want = rows(contract_summaries(df.unionAll(more)))
    assert rows(tables.newest_per_key(tables.stored(spark, f"{folder}/s", "t", q.schema), ["contract_id"])) == want
    # Compacted, the stream goes on in the new folder.
    tables.compact_updates(spark, f"{folder}/s", "t", q.schema, ["contract_id"], f"{folder}/s2")
    last = df.where("ledger < 500").withColumn("event_id", F.concat("event_id", F.lit("y")))
    last.write.mode("append").parquet(f"{folder}/ev")
    live.start_updates(live.summaries_stream(src), f"{folder}/s2", "t", f"{folder}/c1").awaitTermination()
    got = tables.newest_per_key(tables.stored(spark, f"{folder}/s2", "t", q.schema), ["contract_id"])
    assert rows(got) == rows(contract_summaries(df.unionAll(more).unionAll(last)))


def test_dedup_within_lateness(spark, folder):
    df = spark.createDataFrame([("a", 0), ("a", 60), ("b", 100)], "event_id string, s long").withColumn("ledger_closed_at", F.timestamp_seconds("s"))
    src = file_stream(spark, folder, df, "ev")
    q = live.dedup_stream(src).writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/c")
    q.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/o"), "event_id") == [("a",), ("b",)]
