"""From documents to token shards: each stage works on all that the one before it kept."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.llm import decontaminate, mixing, simhash, tokenbin, toxicity  # noqa: E402
from eventloom.llm.registry import settings, table  # noqa: E402
from eventloom.llm.text import write_read  # noqa: E402
from eventloom.session import shared_dir  # noqa: E402


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject."""
    settings(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    settings(spark)
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    settings(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated towards equal weights, no source more than ``mixing.MAX_REPEATS`` times; none is cut."""
    settings(spark)
    epoch = "_epoch" + "_" * max(map(len, docs.columns))  # longer than any column's name
    return mixing.mix(docs, epoch=epoch).drop(epoch)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture and what is read back from them."""
    settings(spark)
    return tokenbin.encode_corpus(docs)


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixing", mixed), ("token_shards", shards)]

# A learnt classifier and a tokenizer are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    settings(spark)
    base = shared_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = write_read(out, f"{base}/{k}-{name}")
    return docs
