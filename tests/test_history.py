"""The pluggable history source: what it opens, and where a stream goes on."""

import json
import os

import pytest
from conftest import rows

from eventloom.sources import archive, history

W = 100


def record(i, ledger, contract="KA"):
    return json.dumps({"id": i, "contract_id": contract, "ledger": ledger, "ledger_closed_at": "2024-01-01T00:00:00Z", "type": "contract", "topic": [], "value": "", "tx_hash": "t"})


def land(spark, folder, *lines):
    made = spark.createDataFrame([(json.loads(x)["ledger"], x) for x in lines], "ledger long, value string")
    history.write_history(made, f"{folder}/h", mode="append", width=W)


def spoil(folder, bucket):
    """A folder whose file cannot be read."""
    os.makedirs(f"{folder}/h/ledger_bucket={bucket}", exist_ok=True)
    with open(f"{folder}/h/ledger_bucket={bucket}/part-0.txt.gz", "wb") as f:
        f.write(b"no gzip at all")


def test_only_files_of_the_range_are_opened(spark, folder):
    land(spark, folder, record("a", 100), record("b", 199), record("c", 200), record("d", 350), "{\"ledger\":260}")
    spoil(folder, 5)
    spoil(folder, 0)
    events, rejects = history.read_history(spark, f"{folder}/h", 150, 360, width=W)
    assert rows(events, "event_id", "ledger") == [("b", 199), ("c", 200), ("d", 350)]
    assert rows(rejects, "reason") == [("id missing",)]
    assert rows(history.read_history(spark, f"{folder}/h", 300, 399, width=W)[0], "event_id") == [("d",)]
    with pytest.raises(Exception, match="gzip|header"):
        history.read_history(spark, f"{folder}/h", 150, width=W)[0].collect()


def test_filters_reach_the_source(spark, folder):
    land(spark, folder, record("a", 100), record("b", 120, "KB"), record("c", 250, "KB"), record("KB", 130, "KA"))
    events = history.read_history(spark, f"{folder}/h", 100, 199, ["KB"], W)[0]
    assert rows(events, "event_id") == [("b",)]
    reader = history.HistoryReader(f"{folder}/h", W)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

    asked = [GreaterThan(("last_ledger",), 199), LessThanOrEqual(("first_ledger",), 250), StringContains(("value",), "KB"), EqualTo(("value",), "x")]
    assert list(reader.pushFilters(asked)) == asked
    parts = reader.partitions()
    assert [p.first for p in parts] == [200] and parts[0].texts == ("KB",)
    lines = [t for part in history.HistoryReader(f"{folder}/h", W).partitions() for b in history._lines(f"{folder}/h", part) for t in b.column(2).to_pylist()]
    assert len(lines) == 4


def test_source_equals_the_archive_scan(spark, folder):
    odd = ["", "  # note", "{broken", record("é x", 105), json.dumps({"ledger": 140, "ledger_close_time": None, "events": [{"id": "z", "contract_id": "KA"}, {"id": "n"}]}), " " + record("a", 100) + "\t"]
    made = spark.createDataFrame([(100 + k, x) for k, x in enumerate(odd)], "ledger long, value string")
    history.write_history(made, f"{folder}/h", width=W)
    got, want = history.read_history(spark, f"{folder}/h", width=W), archive.read_archive(spark, f"{folder}/h", 0)
    assert rows(got[0]) == rows(want[0].select(*got[0].columns)) and rows(got[1]) == rows(want[1]) and got[0].count() == 3


def test_many_lines_come_in_several_batches(spark, folder):
    land(spark, folder, *[record(f"e{k}", 100) for k in range(history.LINES + 7)])
    assert history.read_history(spark, f"{folder}/h", width=W)[0].select("event_id").distinct().count() == history.LINES + 7


def follow(spark, folder, **kwargs):
    raw = history.follow_history(spark, f"{folder}/h", width=W, **kwargs)
    raw.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return [r.event_id for r in spark.read.parquet(f"{folder}/out").orderBy("event_id").collect()]


def test_a_stream_reads_complete_ranges_once(spark, folder):
    land(spark, folder, record("a", 100), record("b", 210))
    assert follow(spark, folder) == ["a"]
    assert follow(spark, folder) == ["a"]
    land(spark, folder, record("c", 220), record("d", 330))
    assert follow(spark, folder) == ["a", "b", "c"]
    land(spark, folder, record("e", 720))
    assert follow(spark, folder) == ["a", "b", "c", "d"]
    assert follow(spark, folder, final=True) == ["a", "b", "c", "d", "e"]


def test_a_stream_starts_at_a_ledger(spark, folder):
    land(spark, folder, record("a", 100), record("b", 210), record("c", 250), record("d", 330))
    spoil(folder, 0)
    assert follow(spark, folder, start_ledger=240) == ["c"]
