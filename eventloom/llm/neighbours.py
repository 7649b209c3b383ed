"""Approximate nearest neighbours by largest cosine: a hash-prefix forest.

Rows are dealt to shards by their id. A shard builds ``TREES`` trees: in each,
every vector gets a string of ``BITS`` signs of random projections, and the
strings are kept as a sorted array. A query descends in each tree to the range
of strings that share its longest prefix, then all trees ascend together, one
symbol at a time, until the ranges hold ``LEAST`` vectors or the share
``SHARE`` of the shard, whichever is more. These candidates are compared by
their exact cosine in double precision on the original vectors. Each shard
hands on its best per query and the best of all shards are taken, so pairs are
never rows of a table.

Equal vectors stand once in a tree with their smallest ids, so a vector that
very many rows have is one point. Queries reach the shards in blocks of
``QUERIES`` at most; a larger set takes several passes.

The share is what recall costs on vectors without structure (see the README);
clustered vectors do with less. ``SHARE`` = 1 is an exact search.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of different length are not compared; of rows
with one id the smallest vector stands; rows with a null id take no part; fewer
candidates than asked for give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from eventloom.llm.registry import query, table

NEAREST = 5
TREES = 64
BITS = 32
LEAST = 1000
SHARE = 0.3
SHARD_ROWS = 8192
QUERIES = 16_384
SEED = 5


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return own.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def _by_length(ids: list[int], vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (ids, matrix); of one id the smallest vector stands."""
    own: dict[int, list[float]] = {}
    for i, v in zip(ids, vectors):
        if i not in own or v < own[i]:
            own[i] = v
    out: dict[int, tuple[list, list]] = {}
    for i in sorted(own):
        group = out.setdefault(len(own[i]), ([], []))
        group[0].append(i)
        group[1].append(own[i])
    return {d: (np.array(i, np.int64), _scaled(np.array(v, np.float64))) for d, (i, v) in out.items()}


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 1 or less.

    Cosines stay the same to the last bit, and squares of very small or very
    large components neither vanish nor overflow.
    """
    exponents = np.frexp(np.abs(vectors).max(1, initial=0))[1]
    return np.ldexp(vectors, -exponents[:, None])


class Forest:
    """Sorted arrays of hash strings over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, per_vector: int, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        rows, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        starts = np.searchsorted(group.ravel()[order], np.arange(len(rows) + 1))
        # The smallest ids of each distinct vector: no more can be among the nearest.
        self.ids = [ids[order[a:min(b, a + per_vector)]] for a, b in zip(starts[:-1], starts[1:])]
        self.vectors, self.norms, self.bits, self.trees = rows, np.sqrt((rows * rows).sum(1)), bits, trees
        self.planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(trees, vectors.shape[1], bits))
        self.weights = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))
        self.orders, self.strings = [], []
        for tree in range(trees):
            strings = self.hash(rows, tree)
            order = np.argsort(strings, kind="stable")
            self.orders.append(order)
            self.strings.append(strings[order])

    def hash(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        signs = vectors @ self.planes[tree] > 0
        return (signs * self.weights).sum(1, dtype=np.uint64)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the strings that share the first x symbols, by query, tree and x."""
        low = np.empty((len(queries), self.trees, self.bits + 1), np.int32)
        high = np.empty_like(low)
        shifts = np.arange(self.bits, -1, -1, dtype=np.uint64)
        for tree in range(self.trees):
            prefix = self.hash(queries, tree)[:, None] >> shifts[None, :]
            first = prefix << shifts[None, :]
            last = first + ((np.uint64(1) << shifts[None, :]) - np.uint64(1))
            low[:, tree] = np.searchsorted(self.strings[tree], first, "left")
            high[:, tree] = np.searchsorted(self.strings[tree], last, "right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, wanted: int) -> np.ndarray:
        """Points met by one query: (tree, x) ranges, all trees ascending together."""
        sizes = (high - low).sum(0)
        x = int(np.flatnonzero(sizes >= wanted)[-1]) if (sizes >= wanted).any() else 0
        met = np.zeros(len(self.vectors), bool)
        while True:
            for tree in range(self.trees):
                met[self.orders[tree][low[tree, x]:high[tree, x]]] = True
            if x == 0 or np.count_nonzero(met) >= wanted:
                return np.flatnonzero(met)
            x -= 1

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: int, share: float) -> Iterator[tuple[int, int, float]]:
        """(query id, id, cosine) of the k nearest candidates of each query."""
        wanted = min(len(self.vectors), max(least, math.ceil(share * len(self.vectors))))
        norms = np.sqrt((queries * queries).sum(1))
        for lo in range(0, len(queries), 512):
            low, high = self.ranges(queries[lo:lo + 512])
            for j in range(len(low)):
                own, vector = int(query_ids[lo + j]), queries[lo + j]
                met = self.candidates(low[j], high[j], wanted)
                cosine = np.einsum("ij,j->i", self.vectors[met], vector) / (self.norms[met] * norms[lo + j])
                # One point may be the query itself; ties at the end are kept until ids decide.
                keep = min(len(met), k + 1)
                edge = np.partition(cosine, len(met) - keep)[len(met) - keep]
                best = [(-c, int(i)) for p, c in zip(met[cosine >= edge].tolist(), cosine[cosine >= edge].tolist()) for i in self.ids[p] if i != own]
                for c, i in sorted(best)[:k]:
                    yield own, i, -c


FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


def search(rows: DataFrame, wanted: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
           trees: int = TREES, bits: int = BITS, least: int = LEAST, share: float = SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which ``wanted`` holds, among all other rows."""
    spark = rows.sparkSession
    own = usable(rows, id_col, vector_col)
    asked = usable(rows.where(wanted), id_col, vector_col)
    count = own.count()
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    dealt = own.repartition(max(1, math.ceil(count / shard_rows)), "id")
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        shared = spark.sparkContext.broadcast(_by_length(part["id"].tolist(), [list(v) for v in part["vector"]]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = [], []
            for batch in batches:
                ids += batch.column(0).to_pylist()
                vectors += batch.column(1).to_pylist()
            for length, (points, matrix) in _by_length(ids, vectors).items():
                if length in shared.value:
                    forest = Forest(points, matrix, k + 1, trees, bits)
                    got = list(forest.nearest(*shared.value[length], k, least, share))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

        one = dealt.mapInArrow(run, FOUND)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_neighbours")
def op4_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
