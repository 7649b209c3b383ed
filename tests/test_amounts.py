"""Amounts are integers: the negative of zero is zero, in the queries and in their SQL."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from eventloom.plans import check  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["decode_value", "src_pages_file", "st_ingest", "st_reorg_cycles", "to_event"])
def test_failed_calls_without_an_amount(spark, folder, name):
    """Errors of no amount and of less than half a cent, whose sign is lost in rounding."""
    for t in check.TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    os.unlink(f"{folder}/events.parquet")
    small = F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.004)
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("value", F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 < 2), small).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{folder}/w")
    os.rename(next(os.path.join(f"{folder}/w", f) for f in os.listdir(f"{folder}/w") if f.endswith(".parquet")), f"{folder}/events.parquet")
    assert e.where("event_type = 'error' and event_id % 4 < 2").count() > 0
    ok, message, _ = check.compare(spark, check.connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
