"""Landed event-listing pages, batch or streaming, one JSON page per line or file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.jsontext import stripped
from eventloom.functions.once import computed_once
from eventloom.schemas import PAGE

REQUIRED = ("type", "ledger", "ledgerClosedAt", "contractId", "id")
_CORRUPT = "_corrupt"


def _parsed(lines: DataFrame) -> DataFrame:
    schema = T.StructType([*PAGE.fields, T.StructField(_CORRUPT, T.StringType())])
    page = F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = computed_once(lines.where(F.length(stripped(F.col("value"))) > 0), "value", page=page)
    incomplete = F.exists(
        "page.events",
        lambda e: e.isNull() | F.greatest(*[e[name].isNull() for name in REQUIRED]),
    )
    bad = (
        F.col(f"page.{_CORRUPT}").isNotNull()
        | F.col("page.latestLedger").isNull()
        | F.col("page.events").isNull()
        | F.coalesce(incomplete, F.lit(False))
    )
    return parsed.withColumn("bad", F.coalesce(bad, F.lit(True)))


def parse_pages(lines: DataFrame, contract_ids: Sequence[str] = ()) -> DataFrame:
    """Raw events of well-formed pages held in a text column ``value``."""
    e = F.col("e")
    empty = F.array().cast("array<string>")
    events = (
        _parsed(lines)
        .where(~F.col("bad"))
        .select(F.explode("page.events").alias("e"))
        .select(
            e["id"].alias("event_id"),
            e["contractId"].alias("contract_id"),
            e["ledger"].alias("ledger"),
            e["ledgerClosedAt"].alias("ledger_closed_at"),
            e["type"].alias("event_type"),
            F.coalesce(e["topic"], empty).alias("topics"),
            F.coalesce(e["value"], F.lit("")).alias("value"),
            F.coalesce(e["txHash"], F.lit("")).alias("tx_hash"),
            F.coalesce(e["inSuccessfulContractCall"], F.lit(False)).alias("in_successful_call"),
            F.coalesce(F.nullif(e["pagingToken"], F.lit("")), e["id"]).alias("paging_token"),
        )
    )
    if contract_ids:
        events = events.where(F.col("contract_id").isin(list(contract_ids)))
    return events


def page_rejects(lines: DataFrame) -> DataFrame:
    """Pages that do not have the listing shape, as their text."""
    return _parsed(lines).where("bad").select("value")


def page_lines(spark: SparkSession, path: str, streaming: bool = False, whole_files: bool = False) -> DataFrame:
    """Page texts of a folder; ``whole_files`` when a page spans several lines."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("wholetext", str(whole_files).lower()).format("text").schema("value string").load(path)


def read_pages(
    spark: SparkSession,
    path: str,
    contract_ids: Sequence[str] = (),
    streaming: bool = False,
    whole_files: bool = False,
) -> DataFrame:
    return parse_pages(page_lines(spark, path, streaming, whole_files), contract_ids)
