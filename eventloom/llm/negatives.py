"""Hard negatives by exact integer scores from Four-Russians tables.

Vectors become integers, floor(``SCALE`` * component). A row is kept as packed
bit planes in two's complement: for each plane, one byte per group of eight
dimensions. For a block of anchors every group gets a table of all 256 sums of
subsets of its eight anchor components; a candidate's byte indexes it, so one
lookup adds eight products of a plane. Lookups of a plane are summed over the
groups and the planes are shifted and added, the top one with a minus sign.
Scores are thus full and exact, for all anchors of the block at once.

Anchors and candidates are dealt by hash to blocks, and each pair of blocks is
a tile that fits one task; a label that a third of the rows have is many
blocks. The first pass scores each anchor's own label and keeps its positives,
the second scores all rows and keeps, per anchor and positive, the best of
another label between ``LOW`` and ``HIGH`` percent of the positive's score.
Every tile hands on its best only, so pairs are never rows of a table. The
work is anchors times rows; nothing goes through the driver but a count.

Defined cases: rows with a null id, label or vector, with a null or non-finite
component, or with components so large that 100 scores of such rows could pass
64 bits take no part; vectors of different length are not compared; of rows
with one id the smallest (label, vector) stands; vectors without components
score 0; ties go to the smaller id; fewer than asked for give fewer rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from eventloom.llm.registry import query, table
from eventloom.llm.text import shuffle_partitions, sorted_runs, write_read
from eventloom.plans.joins import few_rows, lookup_join
from eventloom.session import shared_dir

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
ANCHOR_BLOCK = 512
ROW_BLOCK = 4096
GROUP = 8
# Rows scored at a time, so that sums stay in the processor's cache.
CHUNK = 256

PACKED = StructType([
    StructField("id", LongType()), StructField("label", StringType()), StructField("anchor", BooleanType()), StructField("dims", IntegerType()),
    StructField("planes", IntegerType()), StructField("packed", BinaryType()),
])
ASKED = ArrayType(StructType([StructField("id", LongType()), StructField("score", LongType())]))
FOUND = StructType([StructField("anchor_id", LongType()), StructField("positive_id", LongType()), StructField("positive_score", LongType())])
CHOSEN = StructType([*FOUND.fields, StructField("negative_id", LongType()), StructField("negative_score", LongType())])


def pack(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(planes, bytes by row, plane and group) of integers by row and dimension."""
    planes = 1 + max(int(v).bit_length() for v in (values.max(initial=0), ~values.min(initial=0)))
    wide = np.zeros((len(values), -(-values.shape[1] // GROUP) * GROUP), np.int64)
    wide[:, :values.shape[1]] = values
    bits = (wide[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return planes, np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def unpack(packed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(np.int64(1), np.arange(packed.shape[1], dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("npd,p->nd", bits, weights)


def _stack(planes: list[int], packed: list[bytes], dims: int) -> np.ndarray:
    """Rows of one dimension; those of fewer planes repeat their sign plane."""
    groups, most = -(-dims // GROUP), max(planes)
    out = np.empty((len(planes), most, groups), np.uint8)
    for k, (own, raw) in enumerate(zip(planes, packed)):
        rows = np.frombuffer(raw, np.uint8).reshape(own, groups)
        out[k, :own] = rows
        out[k, own:] = rows[-1]
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """For each group the sums of all subsets of its components: (group, subset, anchor)."""
    count, wide = anchors.shape
    sums = np.zeros((wide // GROUP, 1 << GROUP, count), np.int64)
    for g in range(wide // GROUP):
        for j in range(GROUP):
            sums[g, 1 << j:2 << j] = sums[g, :1 << j] + anchors[:, g * GROUP + j]
    return sums


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, by anchor and row, of packed anchors with packed rows."""
    values = unpack(anchors)
    sums, planes = subset_sums(values), rows.shape[1]
    kind = np.int32 if (int(np.abs(values).sum(1).max(initial=0)) << planes) < 1 << 31 else np.int64
    sums = sums.astype(kind)
    out = np.zeros((len(anchors), len(rows)), kind)
    for lo in range(0, len(rows), CHUNK):
        part = rows[lo:lo + CHUNK]
        total, looked = np.zeros((len(part), len(anchors)), kind), np.empty((len(part), len(anchors)), kind)
        for plane in range(planes - 1, -1, -1):
            total += total
            for g in range(len(sums)):
                np.take(sums[g], part[:, plane, g], axis=0, out=looked)
                total += looked
            if plane == planes - 1:
                np.negative(total, out=total)
        out[:, lo:lo + len(part)] = total.T
    return out


def packed_rows(rows: DataFrame, wanted: Column, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """The rows that take part, as packed bit planes."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"), F.coalesce(wanted, F.lit(False)).alias("anchor"))
    # 100 * dims * component ** 2 stays under 2 ** 63.
    most = F.floor(F.sqrt(F.lit(float(2**63)) / (100.0 * F.greatest(F.size("v"), F.lit(1)))))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    own = own.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.coalesce(sound, F.lit(False)))
    own = own.select("id", "anchor", "label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))
    own = own.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("s")).select("id", "s.label", "s.anchor", "s.v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                planes, packed = pack(flat[starts[at][:, None] + np.arange(d)[None, :]])
                chosen = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    *chosen.columns[:3], pa.array([d] * len(at), pa.int32()), pa.array([planes] * len(at), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary()),
                ], names=PACKED.names)

    return own.mapInArrow(run, PACKED)


def _tiles(rows: DataFrame, anchors: DataFrame, by: list[str], anchor_block: int, row_block: int) -> DataFrame:
    """Rows and anchors (with ``asked``) dealt to tiles, sorted by tile, anchors first: by, i, j, row, id, label, planes, packed, asked."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / row_block).alias("row_blocks"))
    sizes = anchors.groupBy(*by).agg(F.ceil(F.count("*") / anchor_block).alias("anchor_blocks")).join(sizes, by)
    sizes = write_read(sizes, shared_dir(rows.sparkSession, "tiles"))
    few = few_rows(sizes)

    def dealt(side: DataFrame, own: str, other: str, is_row: bool) -> DataFrame:
        block, every = F.pmod(F.xxhash64("id"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        placed = lookup_join(side, sizes, by, few=few).withColumn("own", block).withColumn("other", every)
        i, j = ("other", "own") if is_row else ("own", "other")
        return placed.select(
            *[F.col(b).alias(f"by_{b}") for b in by], F.col(i).alias("i"), F.col(j).alias("j"), F.lit(is_row).alias("row"), "dims", "id", "label", "planes", "packed", "asked"
        )

    none = rows.withColumn("asked", F.lit(None).cast(ASKED))
    both = dealt(anchors, "anchor_blocks", "row_blocks", False).unionByName(dealt(none, "row_blocks", "anchor_blocks", True))
    key = [f"by_{b}" for b in by] + ["i", "j"]
    # Tiles are few and heavy: more partitions than usual keep them apart.
    return both.repartition(4 * shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "row")


def _sides(part: pa.Table) -> tuple[dict, dict, np.ndarray]:
    """Anchors and rows of a tile (lists by column, numpy ids and labels) and their scores."""
    split = pc.sum(pc.invert(part.column("row"))).as_py()
    sides = []
    for side in (part.slice(0, split), part.slice(split)):
        got = {name: side.column(name).to_pylist() for name in ("planes", "packed", "asked", "dims")}
        sides.append(got | {"id": side.column("id").to_numpy(), "label": np.array(side.column("label").to_pylist(), object)})
    anchors, rows = sides
    dims = anchors["dims"][0]
    return anchors, rows, scores(_stack(anchors["planes"], anchors["packed"], dims), _stack(rows["planes"], rows["packed"], dims))


def positives(packed: DataFrame, k: int = POSITIVES, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best other rows of each anchor's label."""
    by = ["dims", "label"]
    tiles = _tiles(packed, packed.where("anchor").withColumn("asked", F.lit(None).cast(ASKED)), by, anchor_block, row_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in sorted_runs(batches, len(by) + 2):
            anchors, rows, got = _sides(part)
            keep, out = min(len(rows["id"]), k + 1), ([], [], [])
            edges = np.partition(got, got.shape[1] - keep, axis=1)[:, got.shape[1] - keep]
            for own, score, edge in zip(anchors["id"].tolist(), got, edges):
                # An anchor may be among its own rows; ties at the end stand until ids decide.
                best = np.flatnonzero((score >= edge) & (rows["id"] != own))
                best = best[np.lexsort((rows["id"][best], -score[best].astype(np.int64)))[:k]]
                out[0].extend([own] * len(best))
                out[1].extend(rows["id"][best].tolist())
                out[2].extend(score[best].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=FOUND.names)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = tiles.mapInArrow(run, FOUND)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def negatives(packed: DataFrame, found: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH,
              anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive the k best rows of another
    label with ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score."""
    asked = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("asked"))
    tiles = _tiles(packed, packed.where("anchor").join(asked, "id"), ["dims"], anchor_block, row_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in sorted_runs(batches, 3):
            anchors, rows, got = _sides(part)
            out: tuple[list, ...] = ([], [], [], [], [])
            for own, label, asked, score in zip(anchors["id"].tolist(), anchors["label"], anchors["asked"], got):
                spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in asked]
                # Spans of negative positives are empty: least > most.
                near = np.flatnonzero((score >= min(s[0] for s in spans)) & (score <= max(s[1] for s in spans)) & (rows["label"] != label))
                falling = -score[near].astype(np.int64)
                order = np.lexsort((rows["id"][near], falling))
                near, falling = near[order], falling[order]
                for p, (least, most) in zip(asked, spans):
                    start = int(np.searchsorted(falling, -most, "left"))
                    for x in near[start:min(start + k, int(np.searchsorted(falling, -least, "right")))].tolist():
                        for column, value in zip(out, (own, p["id"], p["score"], int(rows["id"][x]), int(score[x]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=CHOSEN.names)

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = tiles.mapInArrow(run, CHOSEN).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, wanted: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
         n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Hard negatives of each row for which ``wanted`` holds; see ``negatives``."""
    base = shared_dir(rows.sparkSession, "negatives")
    packed = write_read(packed_rows(rows, wanted, id_col, label_col, vector_col, scale), f"{base}/packed")
    found = write_read(positives(packed, n_positives, anchor_block, row_block), f"{base}/positives")
    return negatives(packed, found, n_negatives, low, high, anchor_block, row_block)


SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.c) = len(b.c)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_negatives", SQL)
def op11_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)
