"""Spelling variants: words one inserted, deleted or replaced code point apart.

Words are counted over whole texts, a table of counts per task first. Near
pairs are found by dense prefix-suffix tiling: words stand in matrices of code
points, padded at the end and, for the suffix, at the front, and two blocks of
words are compared column by column, all pairs of a tile at once. Two words are
one edit apart if the common prefix and suffix together reach the length of the
longer word minus one.

Tiles are laid only where an edit can be: with a longer word of L code points
the prefix or the suffix has at least L // 2 of them, so words are grouped by
these, once for L their own length and once for one more. A group of over
``BLOCK`` words is dealt to blocks by hash and every pair of its blocks is a
tile of its own, so a hot group is many tasks of bounded size. A pair that
shares both halves is reported by its prefix group alone. Pairs, not groups,
are rows, and a pair is a row only if it is near.

Each word's form is its near word with the largest count, ties to the smaller
in code-point order, if that count is at least ``RATIO`` times its own. Chains
of forms are followed by pointer doubling over written tables: counts grow by
``RATIO`` at each step, so a few rounds do.

Defined cases: a null or empty text has no words; a null id counts as an empty
id text in the hash; repeated rows count each time; very long texts and very
long words are taken whole (the matrix of a tile is as wide as its own words);
words without near words keep ``n_near`` 0 and are their own root; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eventloom.llm.registry import query, table
from eventloom.llm.text import shuffle_partitions, sorted_runs, write_read
from eventloom.session import shared_dir

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
DELETE_EVERY = 199
BLOCK = 1024
# Distinct words a task holds before it hands its counts on.
HELD = 200_000

COUNTS = StructType([StructField("word", StringType()), StructField("n", LongType())])
PAIRS = StructType([StructField("word", StringType()), StructField("n", LongType()), StructField("other", StringType()), StructField("other_n", LongType())])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """(word, n): maximal letter runs, A-Z lower-cased, of ``least_length`` code points and ``least_count`` occurrences at least.

    Where ``delete_every`` divides the crc32 h of ``<id>:<run>``, the run loses its code point h % length.
    """
    run = "[a-zÀ-ÿ]{%d,}" % least_length

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(run).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                # On bytes ``lower`` touches A-Z alone.
                for word, n in Counter(find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % delete_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    partial = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, COUNTS)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _points(words: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded behind and, in the second matrix, in front and turned round."""
    ahead = np.full((len(words), width), pad, np.uint32)
    back = np.full_like(ahead, pad)
    for k, word in enumerate(words):
        own = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        ahead[k, :len(own)] = own
        back[k, :len(own)] = own[::-1]
    return ahead, back


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of ``a`` with each row of ``b``; the pads of the two differ."""
    alive = a[:, 0, None] == b[None, :, 0]
    length = alive.astype(np.int32)
    for c in range(1, a.shape[1]):
        if not alive.any():
            break
        alive &= a[:, c, None] == b[None, :, c]
        length += alive
    return length


def tile(first: list[str], second: list[str], longer: int, suffix: bool, same: bool) -> list[tuple[int, int]]:
    """Near pairs of two blocks of words that have ``longer`` code points or one less; ``same``: of one block with itself."""
    a, a_back = _points(first, longer, 0)
    b, b_back = _points(second, longer, 1)
    ahead = _common(a, b)
    near = ahead + _common(a_back, b_back) >= longer - 1
    full_a, full_b = np.array([len(w) == longer for w in first], bool), np.array([len(w) == longer for w in second], bool)
    near &= full_a[:, None] | full_b[None, :]
    if suffix:
        near &= ahead < longer // 2
    if same:
        near = np.triu(near, 1)
    return list(zip(*(x.tolist() for x in np.nonzero(near))))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n): each pair of distinct words one edit apart, once, of a table (word, n) with distinct words."""
    size = F.char_length("word")
    sides = F.explode(F.array(*[
        F.struct(F.lit(suffix).alias("suffix"), length.cast("int").alias("longer"), key.alias("key"))
        for length in (size, size + 1)
        for suffix, key in ((False, F.substring(F.col("word"), F.lit(1), length / 2)), (True, F.right("word", (length / 2).cast("int"))))
    ]))
    keyed = words.select("word", "n", sides.alias("k")).select("word", "n", "k.*")
    group = ["suffix", "longer", "key"]
    counted = keyed.groupBy(*group).agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block)
    dealt = keyed.join(counted, group).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = [*group, "i", "j"]
    dealt = dealt.select(
        *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "word", "n"
    )
    dealt = dealt.repartition(shuffle_partitions(words.sparkSession), *tiles).sortWithinPartitions(*tiles)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str, int]] = []

        def ready() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64()) * 2)], names=PAIRS.names)
            out.clear()
            return done

        for (suffix, longer, _, i, j), rows in sorted_runs(batches, len(tiles)):
            left, word, n = (rows.column(k).to_pylist() for k in (len(tiles), len(tiles) + 1, len(tiles) + 2))
            a = [k for k in range(len(word)) if left[k]]
            b = a if i == j else [k for k in range(len(word)) if not left[k]]
            for x, y in tile([word[k] for k in a], [word[k] for k in b], longer, suffix, i == j):
                out.append((word[a[x]], n[a[x]], word[b[y]], n[b[y]]))
                if len(out) >= 50_000:
                    yield ready()
        if out:
            yield ready()

    return dealt.mapInArrow(compare, PAIRS)


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of a table (word, n) with distinct words."""
    spark = words.sparkSession
    base = shared_dir(spark, "spelling")
    words = write_read(words.select("word", F.col("n").cast("long").alias("n")), f"{base}/words")
    pairs = write_read(near_pairs(words, block), f"{base}/pairs")
    ways = pairs.select("word", "n", "other", "other_n").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    ).unionByName(words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    known = ways.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    led = -F.col("best.less") >= ratio * F.col("n")
    forms = write_read(
        known.select("word", "n", "n_near", F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")), f"{base}/forms"
    )
    roots = write_read(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), f"{base}/roots-0")
    step, moved = 0, 1
    while moved:
        step += 1
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = write_read(
            roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{base}/roots-{step}"
        )
        moved = roots.where("moved").count()
        roots = roots.drop("moved")
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling")
def op13_spelling(spark, sf_dir):
    return variants(word_counts(table(spark, sf_dir, "documents")))
