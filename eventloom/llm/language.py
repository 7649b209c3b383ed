"""Language of texts and of their parts: script ranges, then Viterbi over words.

Training counts letter trigrams (with word borders, hashed to 2^16 buckets) and
scripts per language over all training documents; a task keeps one array per
language and hands on sums. A word's score under a language is the sum of its
trigrams' log probabilities. Scripts narrow the candidates: a language takes
part in a word only if a share of its own training letters stands in that
word's script; a script no language has leaves all of them.

A text's words are labelled by Viterbi decoding with a penalty for each switch
of language, which labels spans of mixed texts. Where no stretch of words
prefers other languages by more than one penalty, the best single language is
the exact answer and the recursion is skipped. The text's language is the one
with most letters; the score is its share of the letters times its posterior
against the other languages over the words it holds.

Defined cases: null texts and texts without letters are ``und`` with score 0
and no spans; a null id is never learnt from and never held out; null
languages are not learnt; without training data everything is ``und``; ties go
to the language that sorts first; repeated rows are labelled one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eventloom.llm.registry import query, table
from eventloom.llm.text import map_batches, remainder, worker_cache

BUCKETS = 1 << 16
SWITCH = 20.0
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
# Code points scored at once.
BLOCK = 1 << 20
# Languages counted at once by a task.
HELD = 64

# First and last code point of scripts; letters elsewhere form script 0.
SCRIPTS = [
    (0x0041, 0x024F), (0x1E00, 0x1EFF), (0x0370, 0x03FF), (0x1F00, 0x1FFF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF),
    (0x0750, 0x077F), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF),
    (0x0D00, 0x0D7F), (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x1200, 0x137F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF),
]
# Ranges that belong to an earlier script of the list.
SAME = {1: 0, 3: 2, 8: 7}


class Points:
    """Per code point: lower case, and 0 for no letter, else 1 + script."""

    def __init__(self):
        n = 0x33480  # above are no letters
        self.kind = np.zeros(n, np.uint8)
        self.lower = np.arange(n, dtype=np.uint32)
        for p in range(n):
            c = chr(p)
            if c.isalpha():
                self.kind[p] = 1
                low = c.lower()
                if len(low) == 1:
                    self.lower[p] = ord(low)
        for k, (lo, hi) in enumerate(SCRIPTS):
            part = self.kind[lo:hi + 1]
            part[part > 0] = 2 + SAME.get(k, k)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(lower-case code points, kinds); points beyond the table are no letters."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        safe = np.where(raw < len(self.kind), raw, 0)
        return self.lower[safe], self.kind[safe]


def points_table() -> Points:
    return worker_cache("points", Points)


def blocks(kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK code points that end between words (a longer word is cut)."""
    lo = 0
    while lo < len(kinds):
        hi = min(len(kinds), lo + BLOCK)
        if hi < len(kinds):
            gaps = np.flatnonzero(kinds[lo:hi] == 0)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        yield lo, hi
        lo = hi


def trigrams(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of letters, bucket of the trigram around each); borders count as code point 0."""
    framed = np.zeros(len(points) + 2, np.uint64)
    framed[1:-1] = np.where(kinds > 0, points, 0)
    at = np.flatnonzero(kinds)
    code = framed[at] * np.uint64(0x9E3779B1) + framed[at + 1] * np.uint64(0x85EBCA77) + framed[at + 2] * np.uint64(0xC2B2AE3D)
    return at, ((code ^ (code >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


COUNTS = StructType([StructField("lang", StringType()), StructField("code", LongType()), StructField("n", LongType())])


def training_counts(rows: DataFrame) -> DataFrame:
    """(lang, code, n) over (lang, text): trigram buckets, and BUCKETS + script for letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = points_table()
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, counts in held.items():
                code = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(counts[code])], names=["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held.get(lang)
                if counts is None:
                    if len(held) >= HELD:
                        yield from out()
                        held.clear()
                    counts = held[lang] = np.zeros(BUCKETS + 256, np.int64)
                points, kinds = table_.of(text)
                for lo, hi in blocks(kinds):
                    _, code = trigrams(points[lo:hi], kinds[lo:hi])
                    counts[:BUCKETS] += np.bincount(code, minlength=BUCKETS)
                counts[BUCKETS:] += np.bincount(kinds[kinds > 0], minlength=256)
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, COUNTS).groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, log P(bucket | language), allowed (script, language)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS:].astype(float)
        total = grams.sum(1, keepdims=True)
        self.logp = np.log((grams + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))) & (scripts > 0)
        self.penalty = np.where(allowed | ~allowed.any(0, keepdims=True), 0.0, -100.0).astype(np.float32)


def fit(docs: DataFrame, training: Column) -> Model:
    """The counts that reach the driver are bounded by languages times buckets."""
    rows = docs.where(training).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = training_counts(rows).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + 256), np.int64)
    if langs:
        counts[np.searchsorted(langs, found["lang"]), found["code"]] = found["n"]
    return Model(langs, counts)


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(starts, ends, scores by language) of the words; None without letters."""
    points, kinds = points_table().of(text)
    starts, ends, scores = [], [], []
    for lo, hi in blocks(kinds):
        k = kinds[lo:hi]
        at, code = trigrams(points[lo:hi], k)
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        start = at[first]
        last = np.append(at[first[1:] - 1], at[-1])
        word = np.stack([np.add.reduceat(row[code], first) for row in model.logp])
        scores.append(word + model.penalty[:, k[start]])
        starts.append(start + lo)
        ends.append(last + lo + 1)
    if not starts:
        return None
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores, axis=1).astype(np.float64)


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language index of each word: the best path with a penalty for each switch."""
    n_langs, n = scores.shape
    best = int(scores.sum(1).argmax())
    if n_langs == 1:
        return np.zeros(n, np.int64)
    gain = np.delete(scores, best, axis=0).max(0) - scores[best]
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    if (sums - np.minimum.accumulate(sums)).max() <= switch:
        return np.full(n, best)
    back = np.zeros((n, n_langs), np.int32)
    value = scores[:, 0].tolist()
    columns = scores.T.tolist()
    for t in range(1, n):
        top = max(value)
        source = value.index(top)
        top -= switch
        row = columns[t]
        for k in range(n_langs):
            if value[k] >= top:
                back[t, k] = k
                value[k] += row[k]
            else:
                back[t, k] = source
                value[k] = top + row[k]
    path = np.zeros(n, np.int64)
    path[-1] = value.index(max(value))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label_text(text: str | None, model: Model) -> tuple[str, float, list[dict]]:
    """(language, score, spans) with spans in code points, from the first to the last word of a stretch."""
    found = word_scores(text, model) if text and model.langs else None
    if found is None:
        return UNKNOWN, 0.0, []
    starts, ends, scores = found
    path = label_words(scores)
    letters = np.bincount(path, weights=ends - starts, minlength=len(model.langs))
    lang = int(letters.argmax())
    total = scores[:, path == lang].sum(1)
    rest = np.delete(total, lang) - total[lang]
    posterior = 1.0 / (1.0 + math.fsum(math.exp(min(700.0, r)) for r in rest))
    cuts = np.flatnonzero(np.diff(path)) + 1
    spans = [
        {"start": int(starts[lo]), "end": int(ends[hi - 1]), "lang": model.langs[path[lo]]} for lo, hi in zip([0, *cuts], [*cuts, len(path)])
    ]
    return model.langs[lang], float(letters[lang] / letters.sum()) * posterior, spans


LABELS = "lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x buckets x 4 bytes
    schema = StructType([StructField("doc_id", LongType()), *StructType.fromDDL(LABELS).fields])

    def run(cols):
        got = [label_text(t, shared.value) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "spans": [g[2] for g in got]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    found = label_documents(docs, model)
    return found.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )
