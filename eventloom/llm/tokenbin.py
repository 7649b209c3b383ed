"""Token ids of a corpus in binary shards with Elias-Fano document bounds.

Documents are dealt by ranges of their id and sorted inside a partition; each
task encodes its texts and writes shards of bounded size. A shard holds, after
a header, the ids of its documents in one array (two or four bytes each, by
the vocabulary), the document bounds and the document ids. Bounds and ids are
rising sequences and kept in Elias-Fano code: low bits packed, high bits in
unary, a position for every 256th one, so that an offset is found by a short
scan and no table of 64-bit offsets exists. The shards' first ids follow from
the manifest, a table that Spark commits; a shard of a lost or repeated task
attempt is in no manifest and is never read.

Shards are read with Spark's own file reader, so any store that Spark reads
will do; they are written through Arrow's file systems.

Encoding: texts are cut at single spaces between two visible characters, where
a byte-level tokenizer always starts a new word, and each piece is encoded
once and remembered; a piece of letters alone goes straight to the tokenizer's
model. Texts with other white space next to a space are cut more carefully,
and a tokenizer of another kind gets whole texts.

Defined cases: a null text is empty and has the end id alone; rows without an
id come first, their id is null when read back; rows with equal ids stand in
the order of their texts; an empty table gives no shard and an empty result.
Only ``doc_id`` and ``text`` are read. A null text comes before an empty one.
"""

from __future__ import annotations

import array
import json
import os
import posixpath
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from eventloom.llm.registry import query, table
from eventloom.llm.text import worker_cache
from eventloom.session import shared_dir

END_ID = 2
# Bytes of ids after which a shard is closed.
SHARD_BYTES = 32 << 20
MEMO = 700_000
SAMPLE = 256
MAGIC = b"IDSHARD1"
# magic, bytes per id, documents, documents without an id, ids, sizes of the three parts, smallest id
HEADER = "<8sIQQQQQQq"


# -- Elias-Fano --------------------------------------------------------------

class EliasFano:
    """A rising sequence of non-negative integers in about 2 + log2(u/n) bits each."""

    HEAD = "<QBQ"

    def __init__(self, data: bytes | memoryview):
        self.n, self.low_bits, high_bytes = struct.unpack_from(self.HEAD, data, 0)
        at = struct.calcsize(self.HEAD)
        samples = (self.n + SAMPLE - 1) // SAMPLE
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        self.high = np.frombuffer(data, np.uint8, high_bytes, at)
        at += high_bytes
        self.low = np.frombuffer(data, np.uint8, (self.n * self.low_bits + 7) // 8, at)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return struct.pack(cls.HEAD, 0, 0, 0)
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        low = b""
        if low_bits:
            spread = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
            low = np.packbits(spread.ravel(), bitorder="little").tobytes()
        return struct.pack(cls.HEAD, n, low_bits, len(high)) + places[::SAMPLE].astype("<u4").tobytes() + high.tobytes() + low

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        stop = start + self.low_bits
        word = int.from_bytes(self.low[start // 8:(stop + 7) // 8].tobytes(), "little")
        return (word >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Place of the i-th one (from 0) among the high bits."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        current = int(self.high[byte]) & (0xFF << (place % 8)) & 0xFF
        while True:
            ones = current.bit_count()
            if left < ones:
                for _ in range(left):
                    current &= current - 1
                return byte * 8 + (current & -current).bit_length() - 1
            left -= ones
            byte += 1
            current = int(self.high[byte])

    def __getitem__(self, i: int) -> int:
        return ((self.select(i) - i) << self.low_bits) | (self._low(i) if self.low_bits else 0)

    def __len__(self) -> int:
        return self.n

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.array([], np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for b in range(self.low_bits):
                out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


# -- shards ------------------------------------------------------------------

def pack_shard(ids: list[bytes], doc_ids: list[int | None], width: int) -> bytes:
    """One shard; ``ids`` holds the little-endian ids of each document, null document ids first."""
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum([len(b) // width for b in ids])]))
    names = EliasFano.encode(np.array([d - least for d in named], dtype=np.uint64))
    body = b"".join(ids)
    head = struct.pack(HEADER, MAGIC, width, len(ids), len(ids) - len(named), len(body) // width, len(body), len(bounds), len(names), least)
    return b"".join([head, body, bounds, names])


class Shard:
    """Reads a shard: document i has ``ids(i)`` and ``doc_id(i)``."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_null, self.n_ids, body, bounds, names, self.least = struct.unpack_from(HEADER, data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(data)
        at = struct.calcsize(HEADER)
        self.body = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)
        self.bounds = EliasFano(view[at + body:at + body + bounds])
        self.names = EliasFano(view[at + body + bounds:at + body + bounds + names])

    def ids(self, i: int) -> np.ndarray:
        return self.body[self.bounds[i]:self.bounds[i + 1]]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.names[i - self.n_null] + self.least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(v) + self.least for v in self.names.values().tolist()]


# -- encoding ----------------------------------------------------------------

EDGE = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
OTHER_SPACE = re.compile(r"[^\S \n]|᠎")
# A line break between visible characters.
LINE = re.compile(r"(?<=[^\s᠎])\n(?=[^\s᠎])")
# Pieces of so many lines are encoded without remembering the lines.
LINES = 64
MARKS = ".,;:!?"


def pieces(text: str) -> list[str]:
    """The text cut at single spaces between visible characters; all but the first piece have lost a space."""
    parts = text.split(" ")
    if "" in parts or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
        return EDGE.split(text)
    return parts


def _byte_letters() -> dict[str, str]:
    """How a byte-level vocabulary writes bytes: visible Latin-1 as itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return str.maketrans({**{chr(b): chr(b) for b in shown}, **{chr(b): chr(256 + i) for i, b in enumerate(hidden)}})


class Pieces:
    """Packed ids of pieces that all stand behind ``lead``, each piece encoded once."""

    def __init__(self, owner: "Encoder", lead: str):
        self.owner, self.lead, self.known = owner, lead, {}

    def join(self, parts: list[str]) -> bytes:
        known = self.known
        missing = [p for p in parts if p not in known]
        if missing:
            if len(known) + len(missing) > MEMO:
                known.clear()
                missing = parts
            for p in missing:
                self.one(p)
        return b"".join(map(known.__getitem__, parts))

    def one(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = self.known[piece] = self._encode(piece)
        return got

    def _encode(self, piece: str) -> bytes:
        owner = self.owner
        if piece.isalpha():
            # A run of letters is one word to the tokenizer: its model alone is asked.
            letters = (self.lead + piece).encode("utf-8").decode("latin-1").translate(owner.letters)
            return owner.pack([t.id for t in owner.model.tokenize(letters)])
        # A mark behind a letter, and a line break between visible characters, are words of their own.
        if piece[-1:] in MARKS and piece[-2:-1].isalpha():
            return self.one(piece[:-1]) + owner.bare.one(piece[-1])
        lines = [m.start() for m in LINE.finditer(piece)]
        if lines:
            # No part holds such a break, so this goes one level down at most; the parts of long pieces are not remembered.
            first, rest = piece[:lines[0]], [piece[lo + 1:hi] for lo, hi in zip(lines, [*lines[1:], len(piece)])]
            encode = owner.bare.one if len(lines) < LINES else owner.bare._encode
            end = owner.bare.one("\n")
            return self.one(first) + b"".join(end + encode(part) for part in rest)
        return owner.whole(self.lead + piece)


class Encoder:
    """Texts to little-endian ids, pieces remembered up to ``MEMO`` of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array.array(self.code).itemsize
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        specials = told.get("added_tokens") or []
        tight = all(not (t.get("lstrip") or t.get("rstrip") or t["content"].isalpha() or re.search(r"\s", t["content"])) for t in specials)
        self.in_pieces = plain and tight and not told.get("normalizer") and told["model"].get("type") == "BPE"
        self.letters = _byte_letters()
        self.spaced, self.bare = Pieces(self, " "), Pieces(self, "")

    def pack(self, ids: list[int]) -> bytes:
        packed = array.array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.in_pieces:
            return self.whole(text)
        cut = pieces(text)
        return self.bare.join(cut[:1]) + self.spaced.join(cut[1:])


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    return worker_cache(("encoder", path), lambda: Encoder(path))


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


MANIFEST = StructType([
    StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("file", StringType()),
    StructField("n_docs", LongType()), StructField("n_ids", LongType()),
])


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` into shards under ``folder``; returns the manifest (part, seq, file, n_docs, n_ids)."""
    spark = docs.sparkSession
    shards = posixpath.join(folder, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = encode.pack([end_id])
        part = TaskContext.get().partitionId()
        system, base = _file_system(shards)
        ids: list[bytes] = []
        names: list[int | None] = []
        size = seq = 0

        def close() -> pa.RecordBatch:
            data = pack_shard(ids, names, encode.width)
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "file": name, "n_docs": len(ids), "n_ids": size // encode.width}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = encode.encode(text or "") + end
                if ids and size + len(got) > shard_bytes:
                    yield close()
                    ids, names, size, seq = [], [], 0, seq + 1
                ids.append(got)
                names.append(doc_id)
                size += len(got)
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(posixpath.join(folder, "manifest"))
    return spark.read.schema(MANIFEST).parquet(posixpath.join(folder, "manifest"))


DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()),
])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the shards."""
    manifest = spark.read.schema(MANIFEST).parquet(posixpath.join(folder, "manifest"))
    # One narrow row per shard. Sums by partition come first, so the order over all is over as many rows as there are partitions.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(parts, "part").select("file", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"))
    if not manifest.take(1):
        return spark.createDataFrame([], DOCUMENTS)
    files = spark.read.format("binaryFile").load(posixpath.join(folder, "shards"))
    read = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(F.broadcast(placed) if placed.count() < 100_000 else placed, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(content.as_py())
                bounds = shard.bounds.values().astype(np.int64)
                crc = [zlib.crc32(shard.body[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read.select("content", "first").mapInArrow(run, DOCUMENTS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_corpus(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write shards to the shared folder and read the documents back from them."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    write_shards(docs, tokenizer or default_tokenizer(), folder)
    return read_documents(spark, folder)


@query("op5_tokenbin")
def op5_tokenbin(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))
