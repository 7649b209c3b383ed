"""SimHash near-duplicates, candidates pruned by pigeonring chains.

A fingerprint has 64 bits in a ring of five segments. If two fingerprints
differ in at most four bits, some start of the ring exists from which every
chain of l consecutive segments differs in at most 4*l/5 bits, rounded down:
0, 1, 2, 3 bits for chains of one to four segments. So

1. fingerprints are dealt by (start, value of the start segment): budget 0,
2. inside a group, sorted by the next segment, partners are looked up for the
   14 values within one bit: budget 1,
3. chains of three and four segments are checked against budgets 2 and 3,
4. only what is left gets the full Hamming check.

Exact copies of a fingerprint are merged first, so a group of copies is one
row. A task hands on a spanning set of links per group (at most one per
member), never its pairs, and works through its candidates in slices of fixed
size. Where a value of two segments gathers more than ``dense`` members, those
members take another exact way, without comparing pairs: two fingerprints
differ in at most four bits if and only if a value exists within two bits of
both, so all fingerprints around one value are linked to their smallest.

Defined cases: null and empty texts have no words and fingerprint zero, linked
like any other; fewer than four words form one shingle; rows may repeat and
ids may repeat (rows with one id are one node); a row without an id gets a
fingerprint and the component of the rows that share it, null if none of them
has an id, and makes no link of its own; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventloom.llm.components import components
from eventloom.llm.registry import query, table
from eventloom.llm.text import map_batches, white_words, write_read
from eventloom.session import shared_dir

SHINGLE = 4
SEED = 42
MAX_BITS = 4
WIDTHS = (13, 13, 13, 13, 12)  # MAX_BITS + 1 segments
OFFSETS = (0, 13, 26, 39, 52)
# Candidate pairs compared at once, and members of one value of two segments
# beyond which pairs are not compared at all.
SLICE = 1 << 20
DENSE = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; a bit is set if more than half of the shingles' hashes have it."""
    words = white_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    tuples = zip(*[words[i:] for i in range(shingle)])
    count = np.zeros(64, np.int64)
    total = len(words) - shingle + 1
    block: list[int] = []
    for shingled in map(join, tuples):
        block.append(digest(shingled, seed))
        if len(block) == 1 << 16:
            count += _bit_counts(block)
            block = []
    if block:
        count += _bit_counts(block)
    return int(np.packbits(count * 2 > total, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as the signed long with the same bits."""

    def run(cols):
        fps = np.array([fingerprint(t) for t in cols["text"]], dtype=np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "fp": fps}

    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType())])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(o)) & np.uint64((1 << w) - 1)).astype(np.int64) for o, w in zip(OFFSETS, WIDTHS)]


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, for links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _group_links(fps: np.ndarray, start: int, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside one group (same start segment): members a, b, and the members left to the dense way."""
    order = np.argsort(_segments(fps)[(start + 1) % 5], kind="stable")
    fps = fps[order]
    segs = _segments(fps)
    ring = [segs[(start + i) % 5] for i in range(5)]
    nxt, width = ring[1], WIDTHS[(start + 1) % 5]
    n = len(fps)
    own_lo, own_hi = np.searchsorted(nxt, nxt, "left"), np.searchsorted(nxt, nxt, "right")
    crowded = own_hi - own_lo > dense
    found_a, found_b = [], []
    lows, highs, whos = [], [], []
    for flip in [0, *[1 << bit for bit in range(width)]]:
        value = nxt ^ flip
        lo, hi = np.searchsorted(nxt, value, "left"), np.searchsorted(nxt, value, "right")
        if flip == 0:
            lo = np.arange(n) + 1  # each pair once
            lo = np.where(crowded, hi, lo)
        else:
            lo = np.where(value < nxt, hi, lo)
        have = np.flatnonzero(hi > lo)
        lows.append(lo[have])
        highs.append(hi[have])
        whos.append(have)
    low, high, who = np.concatenate(lows), np.concatenate(highs), np.concatenate(whos)
    # Next to a crowded value the other side is left to the dense way as well.
    if crowded.any():
        touched = crowded[who] | crowded[np.minimum(low, n - 1)]
        near = np.zeros(n, bool)
        for t in np.flatnonzero(touched):
            near[who[t]] = True
            near[low[t]:high[t]] = True
        left = near | crowded
        low, high, who = low[~touched], high[~touched], who[~touched]
    else:
        left = crowded
    sizes = high - low
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE, "right")) - 1)
        count = sizes[at:stop]
        a = np.repeat(who[at:stop], count)
        b = np.arange(edges[at], edges[stop]) - np.repeat(edges[at:stop] - low[at:stop], count)
        keep = np.ones(len(a), bool)
        differing = np.zeros(len(a), np.int64)
        for i, budget in ((1, 1), (2, 2), (3, 3)):
            differing = differing[keep] if i > 1 else differing
            differing = differing + np.bitwise_count(ring[i][a] ^ ring[i][b])
            keep = differing <= budget
            a, b = a[keep], b[keep]
        exact = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
        if exact.any():
            # Hand on no more than a link per member, however many pairs were found.
            found_a.append(a[exact])
            found_b.append(b[exact])
            if sum(map(len, found_a)) > 4 * n + SLICE:
                label = _spanning(n, np.concatenate(found_a), np.concatenate(found_b))
                has = np.flatnonzero(label != np.arange(n))
                found_a, found_b = [has], [label[has]]
        at = stop
    none = np.array([], np.int64)
    a, b = (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)
    label = _spanning(n, a, b)
    has = np.flatnonzero(label != np.arange(n))
    return order[has], order[label[has]], order[np.flatnonzero(left)]


LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _ring_links(groups: DataFrame, dense: int) -> DataFrame:
    """Rows (start, seg, fp, node) sorted within partitions -> links (a, b) of nodes; b null: fp a takes the dense way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch | None:
            """Links of whole groups."""
            out_a, out_b, marked = [], [], []
            key = rows[0] * (1 << 13) + rows[1]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                if hi - lo > 1:
                    a, b, left = _group_links(rows[2, lo:hi].view(np.uint64), int(rows[0, lo]), dense)
                    node = rows[3, lo:hi]
                    out_a.append(node[a])
                    out_b.append(node[b])
                    if len(left):
                        marked.append(rows[2, lo:hi][left])
            a = np.concatenate(out_a) if out_a else np.array([], np.int64)
            b = np.concatenate(out_b) if out_b else np.array([], np.int64)
            m = np.concatenate(marked) if marked else np.array([], np.int64)
            if not len(a) and not len(m):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, m])), pa.array(np.concatenate([b, np.zeros(len(m), np.int64)]), mask=np.arange(len(a) + len(m)) >= len(a))],
                names=["a", "b"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            held.append(rows)
            last = (rows[0, -1], rows[1, -1])
            if (held[0][0, 0], held[0][1, 0]) != last:
                everything = np.concatenate(held, axis=1)
                whole = int(np.flatnonzero((everything[0] != last[0]) | (everything[1] != last[1]))[-1]) + 1
                out = flush(everything[:, :whole])
                held = [everything[:, whole:]]
                if out is not None:
                    yield out
        if held:
            out = flush(np.concatenate(held, axis=1))
            if out is not None:
                yield out

    return groups.mapInArrow(run, LINKS)


def _around(fps: DataFrame) -> DataFrame:
    """(value, node) for each value within two bits of a fingerprint."""
    one = [1 << i for i in range(64)]
    masks = np.array([0, *one, *[x | y for i, x in enumerate(one) for y in one[i + 1:]]], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 256):
                values = (fp[i:i + 256, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(node[i:i + 256], len(masks)))], names=["value", "node"])

    return fps.mapInArrow(run, StructType([StructField("value", LongType()), StructField("node", LongType())]))


def links(spark: SparkSession, nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``nodes`` (fp, node; fp distinct) within four bits into their components."""
    base = shared_dir(spark, "simhash")
    starts = F.array(*[
        F.struct(F.lit(i).cast("long").alias("start"), F.shiftrightunsigned("fp", o).bitwiseAND(F.lit((1 << w) - 1)).alias("seg"))
        for i, (o, w) in enumerate(zip(OFFSETS, WIDTHS))
    ])
    dealt = nodes.select("fp", "node", F.explode(starts).alias("k")).select("k.start", "k.seg", "fp", "node")
    grouped = dealt.repartition("start", "seg").sortWithinPartitions("start", "seg")
    found = write_read(_ring_links(grouped, dense), f"{base}/ring")
    crowded = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    around = _around(nodes.join(crowded, "fp").select("fp", "node"))
    lowest = around.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("value", "low")
    stars = around.join(lowest, "value").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")) if crowded.take(1) else None
    ring = found.where(F.col("b").isNotNull())
    return ring if stars is None else ring.unionByName(stars)


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) for every document row."""
    spark = docs.sparkSession
    base = shared_dir(spark, "simhash-fp")
    marks = write_read(fingerprints(docs), f"{base}/rows")
    nodes = write_read(marks.groupBy("fp").agg(F.min("doc_id").alias("node")), f"{base}/nodes")
    # One id with several fingerprints is one node: linked through its id. Such ids go first, so copies of one text do not meet here.
    named_rows = marks.where("doc_id is not null")
    several = named_rows.groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2")).where("f1 <> f2").select("doc_id")
    same_id = named_rows.join(several, "doc_id").join(nodes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    named = nodes.where("node is not null")
    found = components(spark, links(spark, named, dense).unionByName(same_id))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(labelled, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """The document with the smallest id of each group, columns as given; rows without an id stay.

    Of rows that repeat an id that stays, one with the smallest text is kept.
    """
    found = near_duplicates(docs, dense)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not again.take(1):
        return rest
    repeated = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text")).alias("_row"))
    return rest.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(repeated.select("_row.*"))


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
