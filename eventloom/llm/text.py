"""Small text and Arrow helpers shared by the operators."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lowered(text: Column | str) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def white_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8.

    On bytes ``lower`` touches A-Z alone and ``split`` cuts at 0x20 and
    0x09-0x0D alone, so no other character is changed.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def crc_remainder(doc_id: int | None, mod: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: StructType) -> DataFrame:
    """Apply ``fn`` to the columns of each Arrow batch (as Python lists)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def worker_cache(key, make: Callable):
    """A value kept in this Python worker between tasks.

    Functions travel by value, so a module's own globals last one task only.
    """
    held = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def write_read(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write Parquet to a shared path and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """For work that is heavier than its rows are wide: adaptive execution joins no partitions that were asked for by number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) for each run of equal values in the first ``keys`` columns of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k)
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
