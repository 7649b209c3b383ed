"""Landed ledger-entry dumps: instance storage and single data keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.wire import decode_scval
from eventloom.schemas import ENTRY


def parse_entries(lines: DataFrame) -> DataFrame:
    """Entry rows of a text column ``value``, one JSON entry per line."""
    entry = F.from_json("value", ENTRY)
    return lines.select(entry.alias("e")).where("e.contract_id is not null and e.last_modified_ledger is not null").select("e.*")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return parse_entries(spark.read.text(path))


def instance_observations(entries: DataFrame) -> DataFrame:
    """(contract_id, wasm_hash, ledger, storage) with storage decoded."""
    return entries.where("storage is not null").select(
        "contract_id",
        "wasm_hash",
        F.col("last_modified_ledger").alias("ledger"),
        decode_scval(F.col("storage")).alias("storage"),
    )


def data_observations(entries: DataFrame, label: str | None = None) -> DataFrame:
    """Single-key rows with key and value decoded and the key's hash."""
    return entries.where("key is not null").select(
        "contract_id",
        F.sha2(F.encode(F.col("key"), "UTF-8"), 256).alias("key_hash"),
        decode_scval(F.col("key")).alias("key"),
        F.col("key").alias("key_xdr"),
        # Anything but "temporary" counts as persistent.
        F.when(F.lower(F.trim("durability")) == "temporary", "temporary").otherwise("persistent").alias("durability"),
        F.col("last_modified_ledger").alias("ledger"),
        decode_scval(F.col("val")).alias("value"),
        F.lit(label).cast("string").alias("label"),
    )
