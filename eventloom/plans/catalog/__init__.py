"""Runnable queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle statement."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def stamped(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as text, so both engines compare the same values."""
    return df.select(*[stamp(c) if c in cols else F.col(c) for c in df.columns])


def counted(df: DataFrame, stats: Observation, *names: str) -> DataFrame:
    """What an observation counted while a table was written, as one row."""
    df.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame([tuple(stats.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


def load() -> None:
    from eventloom.plans.catalog import decoding, delivery, lookups, reading, series, sources, streams  # noqa: F401
