"""Hidden Markov language model: Baum-Welch over the whole corpus, exact scores.

Counts. Words of all training texts are counted (per task, then by word). The
words seen most often, at most ``HEAD`` of them, and the end of a text are
classes of their own; all others fall into ``TAIL`` classes by their crc32. A
word of a tail class has the probability of its class times (c + 0.5) over the
class's sum, so states need parameters for a bounded number of classes only,
whatever the vocabulary, and a word never seen has a share in its class. Rare
words never reach the driver or a broadcast: their counts are joined to the
documents that hold them.

Training. Texts are cut into stretches of ``STRETCH`` tokens for the expected
counts (all of them, every iteration). A task runs scaled forward and backward
recursions over many stretches at once and hands on one row per block of
classes; rows of a block are summed in a stream. What the driver sees is the
parameters, states times classes. A class's emissions are drawn towards its
plain share, the more the rarer it is, so nothing has probability zero.

Scoring. The scaled forward recursion runs over each whole text, however long;
the score is its exact log10 probability under the trained model.

Defined cases: null and empty texts are the end alone; a null id is never
trained on and never held out; repeated rows are scored one by one; without
training texts all counts are zero and scores are those of the flat start;
only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from eventloom.llm.registry import query, table
from eventloom.llm.text import remainder, white_words, write_read
from eventloom.session import shared_dir

STATES = 8
HEAD = 1 << 17
TAIL = 1 << 12
ITERATIONS = 4
STRETCH = 128
# Stretches per forward-backward pass, tokens per scoring pass, rows of a parameter block.
WIDE = 2048
PASS = 4_000_000
BLOCK = 4096
# Sightings by which a class's split over the states is drawn towards their sizes.
PULL = 1.0
SEED = 11
END = b" "  # no word holds a space


# -- counts ------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) with the end of texts as END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(white_words(text))
                counts[END] += 1
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    schema = StructType([StructField("word", BinaryType()), StructField("n", LongType())])
    return docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Bounded part of the counts: head words, sums of tail classes, totals."""

    def __init__(self, head: dict[bytes, int], tail_n: np.ndarray, tail_v: np.ndarray, total: int, distinct: int):
        words = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))
        self.index = {END: 0, **{w: i + 1 for i, w in enumerate(words)}}
        self.n_head = len(self.index)
        self.counts = np.array([head.get(END, 0), *[head[w] for w in words]], dtype=np.float64)
        self.total, self.distinct = total, distinct
        self.log_all = math.log10(total + 0.5 * (distinct + 1))
        self.base = np.log10(self.counts + 0.5) - self.log_all
        mass = tail_n + 0.5 * (tail_v + 1)
        self.log_mass = np.log10(mass)
        plain = np.concatenate([self.counts + 0.5, mass])
        self.plain = plain / plain.sum()


def vocabulary(counts: DataFrame, head: int = HEAD, tail: int = TAIL) -> tuple[Vocabulary, int]:
    """The bounded part and the count from which a word is a head word."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    # Words by count: as many rows as there are different counts; the commonest counts decide, so the large ones may be one row.
    capped = F.least("n", F.lit(1_000_000))
    sizes = sorted(((r["c"], r["k"]) for r in counts.groupBy(capped.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, have = (sizes[0][0] + 1 if sizes else 1), 0
    for c, k in sizes:
        if have + k > head:
            break
        least, have = c, have + k
    top = {bytes(r["word"]): r["n"] for r in counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect()}
    rest = counts.where((F.col("n") < least) & (F.col("word") != F.lit(END)))
    tail_n, tail_v = np.zeros(tail), np.zeros(tail)
    for r in rest.groupBy((F.crc32("word") % tail).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["b"]], tail_v[r["b"]] = r["n"], r["v"]
    return Vocabulary(top, tail_n, tail_v, totals[0] or 0, totals[1] or 0), least


ENCODED = StructType([
    StructField("row", LongType()), StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("trained", BooleanType()),
    StructField("classes", BinaryType()), StructField("n_tokens", LongType()), StructField("head_known", LongType()), StructField("head_base", DoubleType()),
    StructField("tail_words", ArrayType(BinaryType())), StructField("tail_counts", ArrayType(IntegerType())),
])


def encode(docs: DataFrame, vocab, tail: int = TAIL) -> DataFrame:
    """Texts as class numbers, with the rare words that still need their counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        get, crc = v.index.get, zlib.crc32
        for batch in batches:
            row, doc, held, trained, texts = (batch.column(i) for i in range(5))
            out = {f.name: [] for f in arrow}
            for text in texts.to_pylist():
                words = white_words(text)
                codes = np.array([get(w, -1) for w in words] + [0], dtype=np.int32)
                missing = np.flatnonzero(codes < 0)
                known = codes[codes >= 0]
                rare = [words[i] for i in missing.tolist()]
                codes[missing] = [v.n_head + crc(w) % tail for w in rare]
                counted = Counter(rare)
                out["classes"].append(codes.tobytes())
                out["n_tokens"].append(len(codes))
                out["head_known"].append(int((v.counts[known] > 0).sum()))
                out["head_base"].append(float(v.base[known].sum()))
                out["tail_words"].append(list(counted))
                out["tail_counts"].append(list(counted.values()))
            columns = [row, doc, held, trained, *[pa.array(out[f.name], f.type) for f in list(arrow)[4:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("row", "doc_id", "held_out", "trained", "text").mapInArrow(run, ENCODED)


# -- model -------------------------------------------------------------------

class Model:
    """start (K), move (K, K), emit (classes, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_model(plain: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """Slightly different word distributions in states that tend to last."""
    noise = np.random.default_rng(seed).normal(0, 0.7, (len(plain), states))
    emit = plain[:, None] * np.exp(noise)
    move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def expected_counts(stretches: list[np.ndarray], first: list[bool], model: Model, totals: dict[str, np.ndarray]) -> None:
    """Adds the expected counts of the stretches to ``totals``."""
    order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i]))
    lengths = np.array([len(stretches[i]) for i in order])
    flat = np.concatenate([stretches[i] for i in order])
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    opens = np.array([first[i] for i in order])
    states, steps = model.emit.shape[1], int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # stretches longer than t
    alpha = np.zeros((len(flat), states), np.float32)
    scale = np.ones(len(flat), np.float32)
    move = model.move.astype(np.float32)
    flat_start = np.full(states, 1 / states, np.float32)
    now = np.where(opens[:, None], model.start.astype(np.float32), flat_start)
    for t in range(steps):
        b = active[t]
        at = offset[:b] + t
        now = (now[:b] if t == 0 else now[:b] @ move) * model.emit[flat[at]]
        total = now.sum(1)
        now /= total[:, None]
        alpha[at], scale[at] = now, total
    totals["likelihood"] += np.log(scale, dtype=np.float64).sum()
    beta = np.ones((len(lengths), states), np.float32)
    gamma = np.empty_like(alpha)
    for t in range(steps - 1, -1, -1):
        b = active[t]
        at = offset[:b] + t
        gamma[at] = alpha[at] * beta[:b]
        if t:
            weighed = model.emit[flat[at]] * beta[:b] / scale[at][:, None]
            totals["move"] += move * (alpha[at - 1].T @ weighed)
            beta[:b] = weighed @ move.T
    totals["start"] += gamma[offset[opens]].sum(0)
    for k in range(states):
        totals["emit"][:, k] += np.bincount(flat, weights=gamma[:, k], minlength=len(totals["emit"]))


SUMS = StructType([StructField("block", IntegerType()), StructField("counts", BinaryType())])


def expectation(encoded: DataFrame, shared, partitions: int) -> dict[str, np.ndarray]:
    """Expected counts over all training rows; block -1 holds start, moves and likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n, states = model.emit.shape
        totals = {"emit": np.zeros((n, states)), "move": np.zeros((states, states)), "start": np.zeros(states), "likelihood": np.zeros(1)}
        held: list[np.ndarray] = []
        first: list[bool] = []
        for batch in batches:
            for data in batch.column(0):
                codes = np.frombuffer(data.as_buffer(), dtype=np.int32)
                for lo in range(0, len(codes), STRETCH):
                    held.append(codes[lo:lo + STRETCH])
                    first.append(lo == 0)
                    if len(held) == WIDE:
                        expected_counts(held, first, model, totals)
                        held, first = [], []
        if held:
            expected_counts(held, first, model, totals)
        ids, data = [-1], [np.concatenate([totals["likelihood"], totals["start"], totals["move"].ravel()]).astype("<f8").tobytes()]
        for k, lo in enumerate(range(0, n, BLOCK)):
            ids.append(k)
            data.append(totals["emit"][lo:lo + BLOCK].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(data.as_buffer(), "<f8" if block < 0 else "<f4").astype(np.float64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"]
        )

    model = shared.value
    n, states = model.emit.shape
    parts = encoded.where("trained").select("classes").mapInArrow(run, SUMS)
    summed = parts.repartition(partitions, "block").mapInArrow(add, SUMS).collect()  # the parameters: states x classes
    emit, rest = np.zeros((n, states)), np.zeros(1 + states + states * states)
    for r in summed:
        values = np.frombuffer(r["counts"], "<f8")
        if r["block"] < 0:
            rest = values
        else:
            emit[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = values.reshape(-1, states)
    return {"emit": emit, "likelihood": rest[:1], "start": rest[1:1 + states], "move": rest[1 + states:].reshape(states, states)}


def maximise(found: dict[str, np.ndarray], plain: np.ndarray) -> Model:
    """Each class's split over the states is drawn towards the states' sizes by ``PULL`` sightings.

    A class's mean over the states keeps its plain share, so rare classes stay
    near it in every state.
    """
    emit = found["emit"] + 1e-9
    size = emit.sum(0) / emit.sum()
    split = (emit + PULL * size) / (emit.sum(1, keepdims=True) + PULL)
    emit = plain[:, None] * split / size
    move = found["move"] + 1.0
    start = found["start"] + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), (emit / emit.sum(0)).astype(np.float32))


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[Model, list[float]]:
    """Model and the log likelihood before each iteration."""
    spark = encoded.sparkSession
    model, seen = first_model(vocab.plain, states, seed), []
    for _ in range(iterations if vocab.total else 0):
        shared = spark.sparkContext.broadcast(model)  # states x classes
        found = expectation(encoded, shared, 2 + len(vocab.plain) // BLOCK)
        seen.append(float(found["likelihood"][0]))
        model = maximise(found, vocab.plain)
        shared.unpersist()
    return model, seen


def forward(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log probability of each class sequence."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order])
    sizes = lengths[order]
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
    emit, move = model.emit.astype(np.float64), model.move
    logs = np.zeros(len(sizes))
    now = np.broadcast_to(model.start, (len(sizes), len(model.start)))
    for t, b in enumerate(active):
        now = (now[:b] if t == 0 else now[:b] @ move) * emit[flat[offset[:b] + t]]
        total = now.sum(1)
        logs[:b] += np.log(total)
        now = now / total[:, None]
    out = np.empty(len(sizes))
    out[order] = logs
    return out


SCORED = StructType([
    StructField("row", LongType()), StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
    StructField("head_known", LongType()), StructField("head_base", DoubleType()), StructField("sequence", DoubleType()), StructField("n_rare", LongType()),
])


def sequence_scores(encoded: DataFrame, shared, vocab) -> DataFrame:
    """``sequence``: log10 probability of the classes, less the log sums of the tail classes met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, v = shared.value, vocab.value
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sequences = [np.frombuffer(b.as_buffer(), np.int32) for b in whole.column(5)]
            logs = forward(sequences, model) / math.log(10)
            rare = [s[s >= v.n_head] - v.n_head for s in sequences]
            logs -= np.array([v.log_mass[r].sum() for r in rare])
            return pa.RecordBatch.from_arrays(
                [whole.column(i) for i in (0, 1, 2, 3, 4, 6)] + [pa.array(logs), pa.array([len(r) for r in rare], pa.int64())],
                names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "sequence", "n_rare"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += sum(batch.column(3).to_pylist())
                if size >= PASS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return encoded.select("row", "doc_id", "held_out", "n_tokens", "head_known", "classes", "head_base").mapInArrow(run, SCORED)


def score_corpus(docs: DataFrame, training: Column, held_out: Column, states: int = STATES, iterations: int = ITERATIONS,
                 head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark, "hmm")
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(training, F.lit(False)).alias("trained"), "text",
    )
    counts = write_read(word_counts(own.where("trained")), f"{base}/counts")
    vocab, least = vocabulary(counts, head, tail)
    shared_vocab = spark.sparkContext.broadcast(vocab)  # at most head + tail entries
    encoded = write_read(encode(own, shared_vocab, tail), f"{base}/encoded")
    model, _ = train(encoded, vocab, states, iterations)
    # Rare words: one row per document and word, joined with the counts of rare words.
    pairs = encoded.select("row", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("t")).select("row", F.col("t.tail_words").alias("word"), F.col("t.tail_counts").alias("k"))
    rare = counts.where((F.col("n") < least) & (F.col("word") != F.lit(END)))
    n = F.coalesce("n", F.lit(0))
    by_row = pairs.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(n + 0.5)).alias("tail_log"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("tail_known")
    )
    scored = sequence_scores(encoded, spark.sparkContext.broadcast(model), shared_vocab)
    none = F.lit(0.0)
    return scored.join(by_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_log", none) - F.col("n_rare") * F.lit(vocab.log_all)).alias("base_score"),
        (F.col("sequence") + F.coalesce("tail_log", none)).alias("score"),
    )


@query("op8_hmm")
def op8_hmm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 5)
    return score_corpus(docs, training=part != 1, held_out=part == 1)
