"""Contract modules as files, keyed by the SHA-256 of their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.interface import spec_section


def module_sections(modules: DataFrame) -> DataFrame:
    """(wasm_hash, section) of a DataFrame with a binary column ``content``.

    The section is cut out before anything is shuffled, so module bytes never
    travel further than their scan task.
    """
    return modules.select(
        F.sha2("content", 256).alias("wasm_hash"), spec_section(F.col("content")).alias("section")
    )


def attach_modules(modules: DataFrame, contracts: DataFrame) -> DataFrame:
    """(contract_id, wasm_hash, section); contracts maps contract_id to wasm_hash."""
    distinct = module_sections(modules).groupBy("wasm_hash").agg(F.max("section").alias("section"))
    return contracts.select("contract_id", "wasm_hash").join(distinct, "wasm_hash").select(
        "contract_id", "wasm_hash", "section"
    )


def read_modules(spark: SparkSession, path: str, contracts: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return attach_modules(files.select("content"), contracts)
