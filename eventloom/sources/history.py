"""Ledger history as a pluggable source: one partition per file of a ledger range.

``contract_history`` reads newline-delimited history files foldered by ledger
range (``ledger_bucket=<n>``, ``width`` ledgers each, plain or gzip, as
``write_history`` lays them out). Its rows are lines with the range their
folder stands for, so range filters are pushed into the source: files outside
are neither planned nor opened. A ``contains`` filter is pushed as well; the
reader then passes on only lines with that text. Lines are parsed by
``archive.parse_archive`` in built-in expressions, as those of any archive.

The same source follows a growing history: its offset is the ledger range up
to which files were read. A range is read once a file of a later range is
there, or at once with ``final=true``, so a range must be complete when the
next one begins; ranges come in order.

Files are listed and opened by Arrow's file systems: local and mounted folders,
object stores, HDFS with its client library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains,
)
from pyspark.sql.types import StructType

from eventloom.sources.archive import parse_archive
from eventloom.sources.store import LEDGERS_PER_BUCKET, bucket_of

NAME = "contract_history"
SCHEMA = "first_ledger bigint, last_ledger bigint, value string"
# Lines handed to the engine at a time.
LINES = 5_000
_RANGE = re.compile(r"/ledger_bucket=(-?[0-9]+)/[^/]*$")


class Part(InputPartition):
    """A file of one ledger range and the texts its lines must hold."""

    def __init__(self, path: str, first: int, last: int, texts: Sequence[str] = ()):
        super().__init__(None)
        self.path, self.first, self.last, self.texts = path, first, last, tuple(texts)


def _files(path: str, width: int) -> list[Part]:
    """Files of the folders of ledger ranges, in ledger order."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        at = _RANGE.search(info.path)
        if info.is_file and at and not info.base_name.startswith(("_", ".")):
            first = int(at[1]) * width
            found.append(Part(info.path, first, first + width - 1))
    return sorted(found, key=lambda p: (p.first, p.path))


def _lines(path: str, part: Part) -> Iterator:
    """Record batches of a file's lines."""
    import io

    import pyarrow as pa
    from pyarrow import fs

    store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    names = ["first_ledger", "last_ledger", "value"]
    wanted = [t.encode() for t in part.texts]
    held: list[bytes] = []

    def ready() -> pa.RecordBatch:
        texts = pa.array([x.decode("utf-8", "replace") for x in held], pa.string())
        out = pa.RecordBatch.from_arrays([pa.array([part.first] * len(held), pa.int64()), pa.array([part.last] * len(held), pa.int64()), texts], names=names)
        held.clear()
        return out

    # The compression is taken from the file's name.
    with store.open_input_stream(part.path) as stream:
        for line in io.BufferedReader(stream, 1 << 20):
            line = line.rstrip(b"\r\n")
            if all(t in line for t in wanted):
                held.append(line)
                if len(held) >= LINES:
                    yield ready()
    if held:
        yield ready()


class HistoryReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.low: int | None = None
        self.high: int | None = None
        self.texts: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        """Range filters choose files and are left to the engine too; a text filter is done here and there."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("last_ledger",):
                bound = f.value + isinstance(f, GreaterThan)
                self.low = bound if self.low is None else max(self.low, bound)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("first_ledger",):
                bound = f.value - isinstance(f, LessThan)
                self.high = bound if self.high is None else min(self.high, bound)
            elif isinstance(f, StringContains) and f.attribute == ("value",):
                self.texts.append(f.value)
            yield f

    def partitions(self) -> list[Part]:
        return [
            Part(p.path, p.first, p.last, self.texts) for p in _files(self.path, self.width)
            if (self.low is None or p.last >= self.low) and (self.high is None or p.first <= self.high)
        ] or [None]

    def read(self, partition: Part | None) -> Iterator:
        if partition is not None:
            yield from _lines(self.path, partition)


class HistoryStream(DataSourceStreamReader):
    def __init__(self, path: str, width: int, start: int, final: bool):
        self.path, self.width, self.start, self.final = path, width, start, final

    def initialOffset(self) -> dict:
        return {"ledger": self.start}

    def latestOffset(self) -> dict:
        """The end of the complete ranges. It never falls, whatever was read before a restart."""
        ends = sorted({p.last + 1 for p in _files(self.path, self.width)})
        done = ends if self.final else ends[:-1]
        return {"ledger": max([self.start, *done[-1:]])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [p for p in _files(self.path, self.width) if start["ledger"] <= p.last < end["ledger"]]

    def read(self, partition: Part) -> Iterator:
        yield from _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept: ranges are told apart by the offset alone."""


class HistorySource(DataSource):
    """Options: path, width, and for streams start_ledger and final."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _width(self) -> int:
        return int(self.options.get("width", LEDGERS_PER_BUCKET))

    def reader(self, schema: StructType) -> HistoryReader:
        return HistoryReader(self.options["path"], self._width())

    def streamReader(self, schema: StructType) -> HistoryStream:
        return HistoryStream(self.options["path"], self._width(), int(self.options.get("start_ledger", "0")), self.options.get("final", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistorySource)


def read_history(spark: SparkSession, path: str, from_ledger: int = 0, to_ledger: int | None = None, contract_ids: Sequence[str] = (),
                 width: int = LEDGERS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a ledger range, as ``archive.read_archive``; files of other ranges are not opened.

    With one contract, lines without its id are passed over before they are
    parsed, so rejects are then those of lines that name it.
    """
    register(spark)
    lines = spark.read.format(NAME).option("path", path).option("width", str(width)).load().where(F.col("last_ledger") >= from_ledger)
    if to_ledger is not None:
        lines = lines.where(F.col("first_ledger") <= to_ledger)
    # An id of letters and digits stands in a line as it is, without escapes.
    if len(contract_ids) == 1 and contract_ids[0].isascii() and contract_ids[0].isalnum():
        lines = lines.where(F.col("value").contains(contract_ids[0]))
    return parse_archive(lines.select("value"), from_ledger, to_ledger, contract_ids)


def follow_history(spark: SparkSession, path: str, start_ledger: int = 0, contract_ids: Sequence[str] = (), width: int = LEDGERS_PER_BUCKET,
                   final: bool = False) -> DataFrame:
    """Raw events of a growing history as a stream."""
    register(spark)
    reader = spark.readStream.format(NAME).option("path", path).option("width", str(width)).option("final", str(final).lower())
    return parse_archive(reader.option("start_ledger", str(start_ledger)).load().select("value"), start_ledger, None, contract_ids)[0]


def write_history(lines: DataFrame, path: str, mode: str = "overwrite", width: int = LEDGERS_PER_BUCKET, compression: str = "gzip") -> None:
    """Lay out lines (``ledger``, ``value``) by ledger range."""
    placed = lines.select(bucket_of(F.col("ledger"), width).alias("ledger_bucket"), "value")
    placed.repartitionByRange("ledger_bucket", "value").write.mode(mode).partitionBy("ledger_bucket").option("compression", compression).text(path)
