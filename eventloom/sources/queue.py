"""The delivery queue as time buckets.

Open deliveries lie in folders by the time they are due. A round of sending
reads the buckets that came due since the last one, and every row of these
moves on: to a later bucket if it is retried or got no outcome, to the closed
rows if it was delivered or given up. Buckets before the position of the last
round are read by nobody, so nothing is deleted or rewritten: a round reads
what is due and writes what it read, however long the history.

A round owns its folder (``round=<n>``), so a round that is run again replaces
what it wrote; it never reads rows of its own or later rounds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.deliveries import apply_outcomes

BUCKET_SECONDS = 60
PLACE = [T.StructField("round", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("due_bucket", T.LongType())]


def bucket(at: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_seconds(at) / F.lit(seconds))


def put(rows: DataFrame, base: str, round_no: int, position: int, seconds: int = BUCKET_SECONDS) -> None:
    """Write a round's deliveries; open ones lie at ``position`` at the earliest."""
    is_open = F.col("status") == "pending"
    at = F.when(is_open, F.greatest(F.coalesce(bucket(F.col("next_attempt_at"), seconds), F.lit(position)), F.lit(position))).otherwise(F.lit(position))
    placed = rows.withColumns({"open": is_open, "due_bucket": at.cast("bigint")})
    # Rows of one bucket may be many or few: the exchange sizes its partitions by what there is.
    placed.repartitionByRange("open", "due_bucket", "id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("open", "due_bucket").parquet(
        f"{base}/round={round_no}"
    )


def _stored(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    typed = T.StructType([*schema.fields, *PLACE])
    try:
        return spark.read.schema(typed).parquet(base)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed)


def due(spark: SparkSession, base: str, schema: T.StructType, round_no: int, position: int, upto: int) -> DataFrame:
    """Open deliveries of the buckets from the last round's position up to, and without, ``upto``."""
    kept = _stored(spark, base, schema).where(F.col("open") & (F.col("round") < round_no) & F.col("due_bucket").between(position, upto - 1))
    return kept.select(*schema.names)


def settle(rows: DataFrame, outcomes: DataFrame, base: str, now: Column, round_no: int, upto: int, seconds: int = BUCKET_SECONDS, **rules) -> None:
    """Apply a round's outcomes to the rows that were due and move them on; ``rules`` go to ``apply_outcomes``."""
    put(apply_outcomes(rows, outcomes, now, **rules), base, round_no, upto, seconds)


def deliveries(spark: SparkSession, base: str, schema: T.StructType, position: int) -> DataFrame:
    """All deliveries as they stand at a position: open ones at or after it, and closed ones."""
    return _stored(spark, base, schema).where(~F.col("open") | (F.col("due_bucket") >= position)).select(*schema.names)
