"""Skipped and filled ledger ranges, and series whose old folders go, against brute force."""

import random

import pytest
from conftest import rows

from eventloom.operators import gaps, series
from eventloom.sources import snapshots

RANGE = "instance string, from_ledger long, to_ledger long"


def runs(ledgers):
    out = []
    for n in sorted(ledgers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_open_gaps_equal_sets_of_ledgers(spark, chunk):
    rng = random.Random(chunk)

    def made(n, longest):
        out = []
        for _ in range(n):
            low = rng.randrange(1, 400)
            out.append((rng.choice(["a", "a", "a", "b", "c"]), low, low + rng.randrange(-3, longest)))
        return out + out[:5]

    skipped, filled = made(40, 60), made(60, 12)
    odd = [(None, 1, 5), ("a", None, 5), ("a", 5, None)]
    got = gaps.open_gaps(spark.createDataFrame(skipped + odd, RANGE), spark.createDataFrame(filled + odd + [("z", 1, 9)], RANGE), chunk=chunk)
    left = {}
    for k, low, high in skipped:
        left.setdefault(k, set()).update(range(low, high + 1))
    for k, low, high in filled:
        left.get(k, set()).difference_update(range(low, high + 1))
    want = sorted((k, *r) for k, ledgers in left.items() for r in runs(ledgers))
    assert rows(got, "instance", "from_ledger", "to_ledger") == sorted(want, key=repr)
    jobs = rows(gaps.backfill_jobs(got, 9), "instance", "from_ledger", "to_ledger")
    covered = [(k, n) for k, low, high in jobs for n in range(low, high + 1)]
    assert len(covered) == len(set(covered)) and set(covered) == {(k, n) for k, ledgers in left.items() for n in ledgers}
    assert all(high - low < 9 for _, low, high in jobs)


def test_no_ranges(spark):
    none = spark.createDataFrame([], RANGE)
    assert gaps.open_gaps(none, none).count() == 0 and gaps.backfill_jobs(gaps.open_gaps(none, none)).count() == 0
    one = spark.createDataFrame([("a", 5, 9)], RANGE)
    assert rows(gaps.open_gaps(one, none)) == [("a", 5, 9)] and gaps.open_gaps(one, one).count() == 0


def test_moving_the_cut_equals_the_filter(spark, folder):
    rng = random.Random(4)
    keys, width = ["contract_id", "key_hash"], 10
    data = sorted({(f"C{rng.randrange(3)}", f"k{rng.randrange(12)}", rng.randrange(200)) for _ in range(150)})
    df = spark.createDataFrame([(*d, f"v{d[2]}") for d in data], "contract_id string, key_hash string, ledger long, value string")
    snapshots.write_snapshots(df, f"{folder}/rows", keys, width=width)
    at, carried = None, None
    for k, first in enumerate((0, 35, 35, 140, 195)):
        snapshots.move_cut(spark, f"{folder}/rows", keys, first, f"{folder}/carried-{k}", carried, at, width)
        at, carried = first, f"{folder}/carried-{k}"
        got = snapshots.read_snapshots(spark, f"{folder}/rows", at, carried, width)
        assert rows(got) == rows(series.prune_data(df, 1000, 1000 - first) if first else df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ledger_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        snapshots.move_cut(spark, f"{folder}/rows", keys, 3, f"{folder}/x", carried, at, width)


def test_rows_after_the_cut_end_what_was_carried(spark, folder):
    df = spark.createDataFrame([("C", "k", 5, "old"), ("C", "q", 6, "quiet")], "contract_id string, key_hash string, ledger long, value string")
    keys = ["contract_id", "key_hash"]
    snapshots.write_snapshots(df, f"{folder}/rows", keys, width=10)
    snapshots.move_cut(spark, f"{folder}/rows", keys, 20, f"{folder}/c1", width=10)
    assert rows(spark.read.parquet(f"{folder}/c1"), "key_hash") == [("k",), ("q",)]
    more = spark.createDataFrame([("C", "k", 42, "new")], df.schema)
    snapshots.write_snapshots(more, f"{folder}/rows", keys, width=10)
    snapshots.move_cut(spark, f"{folder}/rows", keys, 40, f"{folder}/c2", f"{folder}/c1", 20, 10)
    assert rows(snapshots.read_snapshots(spark, f"{folder}/rows", 40, f"{folder}/c2", 10), "key_hash", "value") == [("k", "new"), ("q", "quiet")]
