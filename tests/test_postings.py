"""Bitmaps of the index are stored and shuffled without the engine's padding."""

from pyspark.sql import functions as F

from eventloom.plans import mapping as M
from eventloom.sources import postings, store

SF = "/root/testdata/sf0.001"


def test_bitmaps_are_short_and_hold_every_folder(spark):
    ev = M.ev(spark, SF)
    # Folders on both sides of a chunk's end, and one below zero.
    edges = [0, 1, postings.CHUNK - 1, postings.CHUNK, 3 * postings.CHUNK + 7, -1]
    one = ev.where("event_name = 'mint'").limit(1)
    spread = one.drop("ledger").crossJoin(spark.createDataFrame([(k * store.LEDGERS_PER_BUCKET,) for k in edges], "ledger long")).select(*ev.columns)
    found = postings.postings(spread)
    assert found.agg(F.max(F.octet_length("folders"))).first()[0] == postings.CHUNK // 8 <= 64
    bits = [(r.chunk * postings.CHUNK + 8 * i + k) for r in found.where(F.col("term") == F.xxhash64(F.lit(one.first().contract_id), F.lit("name"), F.lit("mint"))).collect()
            for i, byte in enumerate(r.folders) for k in range(8) if byte >> k & 1]
    assert sorted(bits) == sorted(edges)
    twice = postings.merged(found, found)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, found.collect()))


def test_no_bitmap_is_shuffled(spark):
    text = postings.postings(M.ev(spark, SF))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = {part: next(i for i, line in enumerate(text) if part in line) for part in ("partial_bitmap_construct_agg", "REPARTITION_BY_COL")}
    assert at["partial_bitmap_construct_agg"] < at["REPARTITION_BY_COL"]  # nearer to the result
