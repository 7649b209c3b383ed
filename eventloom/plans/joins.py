"""Lookup joins that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def size_estimate(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan in bytes (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # The setting is a byte count with an optional unit, or -1 for never.
    text = str(limit).lower().rstrip("b").strip()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    bound = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    return size_estimate(df) <= bound


def few_rows(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether a configuration table has at most so many rows; counted, not estimated."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS, few: bool = False) -> DataFrame:
    """Join a large table to a smaller one on ``on``.

    - ``few`` says that the lookup's rows were counted and are few: it is
      broadcast whatever its estimate.
    - Under the session's broadcast bound the engine decides, and may decide
      anew from measured sizes: a hint would bind it to an estimate.
    - Beyond it, both sides are shuffled with a salt: fact rows spread over
      ``salts`` buckets and every lookup row is copied to each of them, so a key
      holding a third of the facts is split ``salts`` ways and every fact row
      still meets all of its matches exactly once.
    - When the copies would outweigh the facts, both sides are shuffled as they
      are and the engine splits skewed partitions at run time.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how}")
    on = list(on)
    if few:
        return facts.join(F.broadcast(lookup), on, how)
    if fits_broadcast(lookup):
        return facts.join(lookup, on, how)
    if size_estimate(lookup) * salts > size_estimate(facts):
        return facts.join(lookup, on, how)
    return salted_join(facts, lookup, on, how, salts)


def salted_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    # The salt is a function of the row, so a retried task sends it to the same place.
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
