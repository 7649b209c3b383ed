"""Physical plans: pushdown, join choice, native expressions, no cross joins."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from eventloom.plans import catalog, mapping as M  # noqa: E402
from eventloom.operators import matching, reads, series  # noqa: E402
from eventloom.sources import archive  # noqa: E402
from eventloom.plans.joins import fits_broadcast, lookup_join, salted_join  # noqa: E402

SF = "/root/testdata/sf0.001"
# Queries that run a job or a stream while they are built.
EAGER = {"queue_rounds", "typed_events", "src_archive_loaded", "sink_upsert_stats", "reenrich_stats", "src_history", "src_history_contract", "st_history", "retain_data_stored", "q_event_stored", "q_events_by_id", "q_tx_stored", "q_transfers_stored", "q_events_indexed", "q_param_indexed", "src_archive_file", "src_pages_file", "src_entries_file", "st_ingest_enriched", "st_reorg_cycles", "sink_parts", "st_ingest", "st_ingest_summaries", "st_dedup", "st_match", "st_summaries", "st_stats", "st_tail"}
PYTHON = {
    "decode_value", "decode_topics", "to_event", "strkey", "valid_contract", "wasm_section", "parse_interface", "list_functions", "signatures",
    "enrich", "reenrich", "reenrich_stats", "relabel", "storage_key", "holders", "template_keys", "src_pages", "src_wasm", "src_entries",
    "proj_nfts", "q_nfts",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_details(df):
    """Formatted plan text, whose scan entries are not cut short."""
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString("formatted"))


@pytest.fixture()
def stored(spark, folder):
    M.ev(spark, SF).write.parquet(f"{folder}/ev")
    return spark.read.parquet(f"{folder}/ev")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - EAGER))
def test_no_nested_loops_and_python_only_where_needed(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "EvalPython" not in text and "MapIn" not in text


def test_reads_push_filters_and_prune_columns(stored):
    text = scan_details(reads.list_events(stored, "C003", event_name="mint", from_ledger=5).select("event_id", "ledger"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text)[1]
    for part in ("EqualTo(contract_id,C003)", "EqualTo(event_name,mint)", "GreaterThanOrEqual(ledger,5)"):
        assert part in pushed
    assert "TakeOrderedAndProject" in text
    assert "decoded_topics" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_keyset_is_pushed(stored):
    text = scan_details(reads.newest(stored, 10, after=reads.cursor_text(7, "x")))
    assert "Or(LessThan(ledger,7)" in re.search(r"PushedFilters: \[(.*)\]", text)[1]


def test_pruning_pushes_the_cutoff(stored):
    assert "GreaterThanOrEqual(ledger,5)" in plan(series.prune_events(stored, 10, 5))


def test_match_uses_a_hash_join(spark, stored):
    assert "BroadcastHashJoin" in plan(matching.match_events(stored, M.subscriptions(spark, SF)))


def test_large_lookup_is_salted(spark, stored, no_broadcast):
    subs = M.subscriptions(spark, SF)
    assert not fits_broadcast(subs)
    text = plan(matching.match_events(stored.select("*", F.repeat("paging_token", 500).alias("wide")), subs))
    assert "Broadcast" not in text
    assert "_salt" in plan(salted_join(stored, subs.select("contract_id"), ["contract_id"]))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_ones(spark, no_broadcast, how):
    # One key holds most rows; some keys match nothing and some match twice.
    facts = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (99, "d")], "k long, v string")
    plain = facts.join(lookup, "k", how)
    want = sorted(map(tuple, plain.collect()), key=repr)
    for done in (lookup_join(facts, lookup, ["k"], how), salted_join(facts, lookup, ["k"], how)):
        assert done.columns == plain.columns
        assert sorted(map(tuple, done.collect()), key=repr) == want


def test_newest_deliveries_limits_before_the_shuffle(spark):
    from eventloom.operators.aggregates import newest_deliveries

    assert plan(newest_deliveries(M.deliveries(spark, SF))).count("WindowGroupLimit") == 2


def evaluations(df):
    """Python evaluations in a plan."""
    return len(re.findall(r"EvalPython", plan(df)))


def test_each_row_is_read_once(spark):
    """A filter or a second use above must not bring a second evaluation of what is costly."""
    decoded = entry.queries()["to_event"](spark, SF)
    assert evaluations(decoded.where("event_name = 'mint'")) == evaluations(decoded)
    again = entry.queries()["reenrich"](spark, SF)
    assert plan(again).count("CollectMetrics") == 1
    lines = archive.archive_rows(M.archive_lines(spark, SF), 0)
    text = plan(lines.where("reason is null and event_id > 'e5'"))
    assert text.count("Scan parquet") == 1 and text.count("parseJson") == 1


def test_both_sides_of_an_archive_come_from_one_parse(spark, folder):
    events, rejects = archive.load_archive(M.archive_lines(spark, SF), f"{folder}/a")
    lazy = archive.parse_archive(M.archive_lines(spark, SF), 0)
    assert sorted(map(str, events.collect())) == sorted(map(str, lazy[0].select(*events.columns).collect()))
    assert sorted(map(str, rejects.collect())) == sorted(map(str, lazy[1].collect())) and rejects.count() > 0
    assert "PartitionFilters: [isnotnull(rejected" in scan_details(events) and "variant" not in plan(events)
