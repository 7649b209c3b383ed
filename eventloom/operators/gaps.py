"""Ledger ranges as sets: which skipped ranges are still open, and the jobs that fill them.

Ranges are closed (``from_ledger``, ``to_ledger``) and belong to a key. They are
cut at multiples of ``CHUNK`` ledgers first, so each (key, chunk) is swept on
its own and a key with most of the ranges is many tasks; only pieces that touch
a cut are joined again, at most two per key and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# About two months of ledgers.
CHUNK = 1_000_000
JOB_LEDGERS = 4_000


def _edges(ranges: DataFrame, key: str, column: str, chunk: int) -> DataFrame:
    """Steps of the number of ranges over each ledger: one up at the start, one down behind the end."""
    sound = ranges.where("from_ledger <= to_ledger").select(F.col(key).alias("k"), "from_ledger", "to_ledger")
    at = F.sequence(F.floor(F.col("from_ledger") / chunk), F.floor(F.col("to_ledger") / chunk))
    pieces = sound.select("k", "from_ledger", "to_ledger", F.explode(at).alias("chunk"))
    low = F.greatest("from_ledger", F.col("chunk") * chunk)
    high = F.least("to_ledger", F.col("chunk") * chunk + chunk - 1)
    step = F.explode(F.array(F.struct(low.alias("at"), F.lit(1).alias("n")), F.struct((high + 1).alias("at"), F.lit(-1).alias("n"))))
    names = {"skipped": F.lit(0), "filled": F.lit(0), column: F.col("s.n")}
    return pieces.select("k", "chunk", step.alias("s")).select("k", "chunk", F.col("s.at").alias("at"), *[c.cast("bigint").alias(n) for n, c in names.items()])


def open_gaps(skipped: DataFrame, filled: DataFrame, key: str = "instance", chunk: int = CHUNK) -> DataFrame:
    """(key, from_ledger, to_ledger): the largest ranges that were skipped and not filled since.

    Ranges of one key may overlap, repeat and touch; inverted ones are empty;
    rows with a null key or bound take no part.
    """
    steps = _edges(skipped, key, "skipped", chunk).unionByName(_edges(filled, key, "filled", chunk)).where("k IS NOT NULL AND at IS NOT NULL")
    # Equal steps combine before the shuffle.
    summed = steps.groupBy("k", "chunk", "at").agg(F.sum("skipped").alias("skipped"), F.sum("filled").alias("filled"))
    ordered = W.partitionBy("k", "chunk").orderBy("at")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = summed.select(
        "k", "chunk", "at", (F.lead("at").over(ordered) - 1).alias("end"),
        ((F.sum("skipped").over(upto) > 0) & (F.sum("filled").over(upto) == 0)).alias("open"),
    )
    fresh = F.col("open") & ~F.coalesce(F.lag("open").over(ordered), F.lit(False))
    islands = parts.withColumn("island", F.sum(fresh.cast("int")).over(upto)).where("open").groupBy("k", "chunk", "island").agg(F.min("at").alias("low"), F.max("end").alias("high"))
    cut = (F.col("low") == F.col("chunk") * chunk) | (F.col("high") == F.col("chunk") * chunk + chunk - 1)
    along = W.partitionBy("k").orderBy("low")
    apart = F.coalesce(F.lag("high").over(along) + 1 != F.col("low"), F.lit(True))
    run = F.sum("apart").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = islands.where(cut).withColumn("apart", apart.cast("int")).withColumn("run", run).groupBy("k", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = islands.where(~cut).select("k", "low", "high").unionByName(joined.select("k", "low", "high"))
    return whole.select(F.col("k").alias(key), F.col("low").alias("from_ledger"), F.col("high").alias("to_ledger"))


def backfill_jobs(gaps: DataFrame, job_ledgers: int = JOB_LEDGERS, key: str = "instance") -> DataFrame:
    """Open gaps cut into jobs of at most ``job_ledgers``; each open ledger is in one job."""
    starts = F.explode(F.sequence(F.col("from_ledger"), F.col("to_ledger"), F.lit(job_ledgers).cast("bigint")))
    cut = gaps.select(F.col(key), starts.alias("first"), F.col("to_ledger").alias("last"))
    return cut.select(key, F.col("first").alias("from_ledger"), F.least("last", F.col("first") + job_ledgers - 1).alias("to_ledger"))
