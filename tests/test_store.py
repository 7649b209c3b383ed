"""Point lookups and the inverted index on stored tables: what is found, and what is read for it."""

import hashlib
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.functions import ids
from eventloom.operators import reads, verticals
from eventloom.plans import mapping as M
from eventloom.sources import postings, store

SF = "/root/testdata/sf0.001"
TX = [hashlib.sha256(t.encode()).hexdigest() for t in ("tx7", "tx100")]


def scanned(df):
    """(files read, rows that left the scans) of a run."""
    df.collect()
    todo, files, out = [df._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage") or "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                files += node.metrics().apply("numFiles").value()
                out += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return files, out


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("store"))
    ev = M.encoded_events(spark, SF)
    # Many small row groups: what a large folder has.
    many = ev
    for k in range(1, 6):
        many = many.unionByName(ev.withColumn("tx_hash", F.concat("tx_hash", F.lit(f"-{k}"))).withColumn("event_id", F.regexp_replace("event_id", "0$", str(k))))
    many = many.withColumns({"tx_hash": F.sha2("tx_hash", 256), "paging_token": F.sha2("event_id", 512)})
    store.write_events(many, f"{base}/events", row_group_bytes=2_000)
    store.write_derived(verticals.token_transfers(ev), f"{base}/transfers", "token_transfers")
    postings.write_postings(postings.postings(many), f"{base}/postings")
    return base


def test_ids_name_their_ledger(spark):
    made = spark.createDataFrame([(7, 5), (2**31 - 1, 2**32 - 1)], "l long, o long").select(ids.event_id_at(F.col("l"), F.col("o"), F.lit(3)).alias("i"))
    texts = [r.i for r in made.collect()]
    assert [ids.ledger_in(t) for t in texts] == [7, 2**31 - 1] and all(len(t) == 30 for t in texts)
    other = ["", "x", "12", "0-1", "5-1", "12-x", "99999999999999999999-1", "9999999999999999999-1", "-1"]
    both = spark.createDataFrame([(t,) for t in texts + other], "i string").select("i", ids.ledger_of(F.col("i")).alias("l"))
    assert {r.i: r.l for r in both.collect()} == {t: ids.ledger_in(t) for t in texts + other}


def test_an_id_reads_its_folder_and_row_group_only(spark, path):
    stored = spark.read.parquet(f"{path}/events")
    total, wanted = stored.count(), stored.agg(F.max("event_id")).first()[0]
    found = store.find_event(spark, f"{path}/events", wanted)
    assert rows(found, "event_id") == [(wanted,)]
    files, out = scanned(store.find_event(spark, f"{path}/events", wanted))
    assert files < stored.select("ledger_bucket").distinct().count() and 0 < out < total / 20
    assert "PartitionFilters: [isnotnull(ledger_bucket" in found._jdf.queryExecution().toString()
    assert store.find_event(spark, f"{path}/events", "no ledger here").count() == 0


def test_bloom_filters_skip_row_groups(spark, path, folder):
    """A transaction that no row group's range can exclude."""
    stored = spark.read.parquet(f"{path}/events")
    found = store.find_values(spark, f"{path}/events", "tx_hash", TX)
    assert rows(found, "event_id", "tx_hash") == rows(stored.where(F.col("tx_hash").isin(TX)), "event_id", "tx_hash") != []
    with_blooms = scanned(store.find_values(spark, f"{path}/events", "tx_hash", TX[:1]))[1]
    store.write_events(stored.drop("ledger_bucket"), f"{folder}/plain", blooms=(), row_group_bytes=2_000)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.filter.bloom.enabled", "false")
    conf.set("parquet.filter.dictionary.enabled", "false")
    try:
        without = scanned(store.find_values(spark, f"{folder}/plain", "tx_hash", TX[:1]))[1]
    finally:
        conf.unset("parquet.filter.bloom.enabled")
        conf.unset("parquet.filter.dictionary.enabled")
    assert 0 < with_blooms < without / 3


def test_many_values_and_addresses(spark, path):
    stored = spark.read.parquet(f"{path}/transfers")
    wanted = [f"G{k}" for k in range(0, 60, 2)] * 2
    got = store.find_values(spark, f"{path}/transfers", "from_addr", wanted)
    assert rows(got, "event_id") == rows(stored.where(F.col("from_addr").isin(wanted)), "event_id") != []
    assert store.find_values(spark, f"{path}/transfers", "from_addr", []).count() == 0


def test_ids_of_a_table_read_the_folders_they_name(spark, path):
    stored = spark.read.parquet(f"{path}/events")
    first = stored.agg(F.min("ledger_bucket")).first()[0]
    wanted = stored.where(F.col("ledger_bucket") == first).select("event_id").limit(20)
    wanted = spark.createDataFrame([tuple(r) for r in wanted.collect()] * 2 + [("none",), (None,)], "event_id string")
    found = store.find_events(spark, f"{path}/events", wanted)
    assert re.search(r"PartitionFilters: \[ledger_bucket#\d+ = |ledger_bucket#\d+ IN|\(ledger_bucket#\d+ = ", found._jdf.queryExecution().executedPlan().toString())
    assert rows(found, "event_id") == sorted({(r.event_id,) for r in wanted.collect()} & {(r.event_id,) for r in stored.collect()})
    assert found.count() == 20
    some = store.find_events(spark, f"{path}/events", wanted.where("event_id <> 'none'"))
    assert rows(some, "event_id") == rows(found, "event_id") and scanned(some)[0] <= stored.where(F.col("ledger_bucket") == first).select(F.input_file_name()).distinct().count()
    plain = spark.createDataFrame([("000000000009",)], "event_id string")
    store.write_events(M.ev(spark, SF), f"{path}/plain")
    assert store.find_events(spark, f"{path}/plain", plain).count() == 1  # ids without a ledger are looked up everywhere


def test_index_equals_the_scan_on_all_topics(spark, path):
    stored = spark.read.parquet(f"{path}/events")
    everywhere = {r[0] for r in stored.select("ledger_bucket").distinct().collect()}
    combos = stored.selectExpr("contract_id", "event_name", "decoded_topics[1] AS a", "decoded_topics[2] AS b", "ledger_bucket").distinct().collect()
    want = {}
    for r in combos:
        a, b = r.a.strip('"'), r.b.strip('"')
        for key in ((r.contract_id, r.event_name, None, None), (r.contract_id, None, a, None), (r.contract_id, None, None, b), (r.contract_id, r.event_name, a, b)):
            if key[1] is not None or key[2] is not None or key[3] is not None:
                want.setdefault(key, set()).add(r.ledger_bucket)
    fewer = 0
    for contract, name, a, b in sorted(want, key=repr)[::80]:
        topics = {k: t for k, t in ((1, a), (2, b)) if t is not None}
        at = postings.folders(spark, f"{path}/postings", contract, name, topics)
        assert want[contract, name, a, b] <= set(at) <= everywhere
        filters = {"event_name": name, "topics": topics}
        got = postings.list_events(spark, f"{path}/events", f"{path}/postings", contract, limit=1000, **filters)
        assert rows(got, "event_id") == rows(reads.list_events(stored, contract, limit=1000, **filters), "event_id") != []
        fewer += len(at) < len(everywhere)
    assert fewer > 3


def test_index_searches_parameters_and_misses(spark, path):
    stored = spark.read.parquet(f"{path}/events")
    got = postings.list_events(spark, f"{path}/events", f"{path}/postings", "C003", limit=1000, param=("k", "7"))
    assert rows(got, "event_id") == rows(reads.list_events(stored, "C003", limit=1000, param=("k", "7")), "event_id") != []
    assert postings.folders(spark, f"{path}/postings", "C003", topics={0: "no such"}) == []
    nothing = postings.list_events(spark, f"{path}/events", f"{path}/postings", "C003", topics={1: "no such"})
    assert nothing.count() == 0 and scanned(nothing)[0] == 0
    assert postings.folders(spark, f"{path}/postings", "C003") is None
    whole = postings.list_events(spark, f"{path}/events", f"{path}/postings", "C003", limit=10)
    assert rows(whole, "event_id") == rows(reads.list_events(stored, "C003", limit=10), "event_id")


def test_merged_postings_equal_one_build(spark):
    ev = M.ev(spark, SF)
    half = F.crc32(F.encode("event_id", "UTF-8")) % 2 == 0
    far = ev.withColumn("ledger", F.col("ledger") + store.LEDGERS_PER_BUCKET * postings.CHUNK)
    whole = ev.unionByName(far)
    apart = postings.merged(postings.postings(ev.where(half)), postings.postings(ev.where(~half).unionByName(far)))
    assert rows(apart) == rows(postings.postings(whole)) and whole.count() > 0
    text = apart._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in text  # combined before the shuffle
