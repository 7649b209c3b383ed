"""Storage layout of the event table and of tables derived from it.

Ledger-range folders, files clustered by contract. Columns that are looked up
on their own (ids, transactions, addresses) carry Bloom filters, so a lookup
that names no contract still skips the row groups without its value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.ids import ledger_in, ledger_of

# About one day at a five-second ledger cadence.
LEDGERS_PER_BUCKET = 17_280
# Columns with Bloom filters, by table.
LOOKED_UP = {
    "events": ("event_id", "tx_hash"),
    "token_transfers": ("event_id", "from_addr", "to_addr"),
    "amm_swaps": ("event_id", "sender", "sell_token", "buy_token"),
    "nft_events": ("event_id", "from_addr", "to_addr", "token_id"),
    "liquidity_events": ("event_id", "provider"),
}
# Values of one IN filter that the scan tests one by one; of more it only tests the range.
VALUES_TESTED = 10
# Folders a batch of ids may name one by one; a batch over more reads all.
FOLDERS_NAMED = 10_000


def bucket_of(ledger: Column, width: int = LEDGERS_PER_BUCKET) -> Column:
    return F.floor(ledger / F.lit(width))


def with_bucket(df: DataFrame, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    return df.withColumn("ledger_bucket", bucket_of(F.col("ledger"), width))


def clustered(df: DataFrame, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """Rows with their ledger bucket, placed and sorted for writing.

    The range exchange samples the whole sort key, so a contract with most of a
    bucket's rows is spread over several files instead of one task, and a task
    writes only few folders.
    """
    order = [F.col("ledger_bucket"), F.col("contract_id"), F.col("ledger").desc(), F.col("event_id")]
    return with_bucket(df, width).repartitionByRange(*order).sortWithinPartitions(*order)


def with_blooms(writer: DataFrameWriter, columns: Sequence[str]) -> DataFrameWriter:
    """Bloom filters for columns, sized by the values a row group turns out to have."""
    for name in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{name}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def write_events(df: DataFrame, path: str, mode: str = "overwrite", width: int = LEDGERS_PER_BUCKET, blooms: Sequence[str] = LOOKED_UP["events"],
                 row_group_bytes: int | None = None) -> None:
    """Ledger-range folders, files clustered by contract, newest ledger first, Bloom filters on ``blooms``."""
    writer = with_blooms(clustered(df, width).write.mode(mode).partitionBy("ledger_bucket"), [c for c in blooms if c in df.columns])
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def write_derived(df: DataFrame, path: str, table: str, mode: str = "overwrite", width: int = LEDGERS_PER_BUCKET) -> None:
    """A derived table (``LOOKED_UP``) in the same layout."""
    write_events(df, path, mode, width, LOOKED_UP[table])


def read_events(
    spark: SparkSession,
    path: str,
    from_ledger: int | None = None,
    to_ledger: int | None = None,
    width: int = LEDGERS_PER_BUCKET,
    folders: Sequence[int] | None = None,
) -> DataFrame:
    """Stored rows of a ledger range; folders outside it, or not among ``folders`` when given, are not listed."""
    df = spark.read.parquet(path)
    if folders is not None:
        df = df.where(F.col("ledger_bucket").isin(list(folders)))
    if from_ledger is not None:
        df = df.where((F.col("ledger_bucket") >= from_ledger // width) & (F.col("ledger") >= from_ledger))
    if to_ledger is not None:
        df = df.where((F.col("ledger_bucket") <= to_ledger // width) & (F.col("ledger") <= to_ledger))
    return df.drop("ledger_bucket")


def find_event(spark: SparkSession, path: str, event_id: str, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """One stored event: its id names the folder, the Bloom filters the row group."""
    ledger = ledger_in(event_id)
    return read_events(spark, path, ledger, ledger, width).where(F.col("event_id") == event_id)


def find_events(spark: SparkSession, path: str, ids: DataFrame, width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """Stored events of a table of ids (column ``event_id``), each once.

    The folder is a join key taken from the id. The folders named are collected
    first, if no more than ``FOLDERS_NAMED``, so that the scan lists no others
    whatever way the engine joins. Ids that encode no ledger are looked up in
    all folders.
    """
    wanted = ids.select("event_id").distinct().withColumn("ledger_bucket", bucket_of(ledger_of(F.col("event_id")), width))
    named = wanted.select("ledger_bucket").distinct().limit(FOLDERS_NAMED + 1).collect()
    stored = spark.read.parquet(path)
    folders = [r[0] for r in named if r[0] is not None]
    near = stored.where(F.col("ledger_bucket").isin(folders)) if len(named) <= FOLDERS_NAMED else stored
    found = near.join(wanted, ["ledger_bucket", "event_id"], "left_semi")
    if len(folders) < len(named):
        found = found.unionByName(stored.join(wanted.where("ledger_bucket IS NULL"), "event_id", "left_semi"))
    return found.drop("ledger_bucket")


def find_values(spark: SparkSession, path: str, column: str, values: Sequence[str], from_ledger: int | None = None, to_ledger: int | None = None,
                width: int = LEDGERS_PER_BUCKET) -> DataFrame:
    """Stored rows with one of some values of a looked-up column (a transaction, an address).

    Values are tested against the Bloom filters in runs of ``VALUES_TESTED``;
    rows stand once, as a row has one value.
    """
    kept = read_events(spark, path, from_ledger, to_ledger, width)
    wanted = sorted(set(values))
    found = kept.where(F.lit(False))
    for lo in range(0, len(wanted), VALUES_TESTED):
        part = kept.where(F.col(column).isin(wanted[lo:lo + VALUES_TESTED]))
        found = part if lo == 0 else found.unionByName(part)
    return found
