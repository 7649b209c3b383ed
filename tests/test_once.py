"""Steps in Python run once per row, however the result is used."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom.operators.convert import to_events  # noqa: E402
from eventloom.plans import mapping as M  # noqa: E402
from eventloom.plans.catalog.decoding import _interfaces  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def evaluations(df):
    return len(re.findall(r"EvalPython", plan(df)))


def test_filters_on_the_record_name_user_types_once(spark):
    events = to_events(M.raw(spark, SF), _interfaces(spark, SF))
    found = events.where("enriched is not null").select("event_id", F.get_json_object("enriched", "$.event").alias("name")).where("name = 'mint'")
    assert plan(found).count("[_relabel_batch(") == plan(events).count("[_relabel_batch(") == 1
    assert found.count() > 0


@pytest.mark.parametrize("user", [5, 29, 0, -3, None])
def test_contract_keys_come_from_a_table(spark, user):
    """Every event keeps its row, also of users that no table has."""
    e = spark.createDataFrame([(1, user, "mint", 1.0)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    got = M.raw_from(e).select("contract_no", "contract_id").collect()
    want = spark.range(1).select(M.wire.strkey(M.wire.CONTRACT_VERSION, M.wire_contract_key(F.lit(user).cast("long") % 25))).first()[0]
    assert [r.contract_id for r in got] == [want] and (want is None) == (user is None)
    assert re.search(r"BroadcastHashJoin \[contract_no#\d+L\], .*LeftOuter", plan(M.raw_from(e)))


def test_landed_pages_grow_in_files_not_in_file_size(spark, folder, monkeypatch):
    from eventloom.plans.catalog import streams

    monkeypatch.setattr(streams, "FILE_PAGES", 150)
    assert streams._landed(spark, SF, f"{folder}/pages", 2) == 14  # 2,000 pages
    per_file = spark.read.text(f"{folder}/pages").groupBy(F.input_file_name()).count()
    counts = [r["count"] for r in per_file.collect()]
    assert len(counts) == 14 and sum(counts) == 2_000 and max(counts) < 200


def test_landed_pages_are_packed(spark, folder):
    """Pages of many copies take a fraction of their text on disk, each event as often as asked."""
    from eventloom.plans.catalog import streams

    streams._landed(spark, SF, f"{folder}/pages", 2)
    pages = spark.read.text(f"{folder}/pages")
    files = [f"{folder}/pages/{f}" for f in os.listdir(f"{folder}/pages") if f.startswith("part-")]
    text = pages.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert sum(map(os.path.getsize, files)) < text / 4
    want = M.page_lines_from(M.table(spark, SF, "events"))
    assert sorted(r[0] for r in pages.collect()) == sorted(r[0] for r in want.unionAll(want).collect())


def test_cycles_are_landed_spread_and_packed(spark, folder, monkeypatch):
    from eventloom.plans import catalog
    from eventloom.plans.catalog import streams

    monkeypatch.setattr(streams, "shared_dir", lambda _, name: f"{folder}/{name}")
    monkeypatch.setattr(streams, "FILE_PAGES", 150)
    assert catalog.QUERIES["st_reorg_cycles"](spark, SF).count() == 1000
    per_file = spark.read.text(f"{folder}/reorg/pages").groupBy(F.input_file_name().alias("f")).count().collect()
    # 1,000 pages, 334 twice and 167.
    assert len(per_file) == 7 + 4 + 4 + 4 and max(r["count"] for r in per_file) < 200
    assert all(r["f"].endswith(".gz") for r in per_file)


@pytest.mark.parametrize("name", ["list_functions", "signatures", "parse_interface"])
def test_modules_are_spread_and_parsed_once(spark, name):
    from eventloom.plans import catalog

    text = plan(catalog.QUERIES[name](spark, SF))
    assert len(re.findall(r"ArrowEvalPython \[_interface_batch\(", text)) == 1
    assert "REPARTITION_BY_COL" in text


def test_retried_events_are_read_once(spark):
    from eventloom.plans import catalog

    text = plan(catalog.QUERIES["reenrich"](spark, SF))
    assert text.count("_decode_list_batch(") == plan(catalog.QUERIES["enrich"](spark, SF)).count("_decode_list_batch(") and "Union" not in text


def test_a_batch_of_new_ids_is_not_sorted_out(spark, folder, monkeypatch):
    from eventloom.operators import merge
    from eventloom.streaming import ingest

    sorted_out = []
    plain = merge.first_copies
    monkeypatch.setattr(merge, "first_copies", lambda rows, order=None: sorted_out.append(rows) or plain(rows, order))
    raw = M.raw(spark, SF)
    n = F.col("event_id").cast("bigint")
    other = raw.where(n < 700).withColumn("value", F.lit("AAAAAwAAAAc="))
    batches = [
        (raw.where(n < 400), 400, 0),
        (raw.where((n >= 400) & (n < 500)), 500, 0),  # new
        (raw.where(n < 600), 600, 0),  # some stored
        (raw.where((n >= 600) & (n < 700)).unionByName(other.where(n >= 600)), 700, 1),  # repeated, with other content
        (raw.unionByName(raw).unionByName(other), 1000, 1),  # repeated and stored
        (raw.where("false"), 1000, 0),
    ]
    for k, (batch, stored, steps) in enumerate(batches):
        sorted_out.clear()
        ingest.ingest_batch(batch, k, f"{folder}/out")
        found = ingest.committed_events(spark, f"{folder}/out")
        assert (found.count(), found.select("event_id").distinct().count(), len(sorted_out)) == (stored, stored, steps)
    # The smaller row of two copies stands, and a stored row stays.
    want = to_events(raw).select("event_id", "decoded_value").collect()
    small = {r[0] for r in other.where(n >= 600).select("event_id").collect()}
    got = {r[0]: r[1] for r in found.select("event_id", "decoded_value").collect()}
    assert all(got[i] == v or (i in small and got[i] == "7") for i, v in want)


def test_template_keys_take_two_python_steps(spark):
    """One reads the values; one finds the texts of topics and tests their addresses, in one process."""
    from eventloom.plans import catalog

    found = catalog.QUERIES["template_keys"](spark, SF)
    assert evaluations(found) == 3  # with the contract keys of the lookup table


def test_events_are_spread_before_they_are_decoded(spark, folder):
    """One file of one row group is decoded and named by several tasks, each event once."""
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(f"{folder}/events.parquet")
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(size)
    spark.conf.set(size, "1k")  # the table is this small too
    try:
        named = to_events(M.raw(spark, folder), _interfaces(spark, SF))
        named.select("event_id", "enriched", F.spark_partition_id().alias("task")).write.parquet(f"{folder}/named")
    finally:
        spark.conf.set(size, before)
    got = spark.read.parquet(f"{folder}/named").agg(F.count("*"), F.count_distinct("event_id"), F.count_distinct("task")).first()
    assert got[0] == got[1] == 1_000 and got[2] > 1
