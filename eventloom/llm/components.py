"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.text import write_read
from eventloom.session import shared_dir


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest node of its neighbourhood, so a chain shortens by a power each
    round and a star stays as it is. Minima are aggregates with map-side
    combine; a node with very many links meets them in a join that adaptive
    execution may split. Every round is a written table, so a lost executor
    costs one round at most, and the driver sees two numbers per round.
    """
    base = shared_dir(spark, "components")
    current = write_read(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{base}/0")
    step, before = 0, None
    while True:
        both = current.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            current.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        large = large.where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(down, "hi")
        small = joined.select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))
        step += 1
        current = write_read(small.where("hi <> lo").distinct(), f"{base}/{step}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    heads = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(heads)
