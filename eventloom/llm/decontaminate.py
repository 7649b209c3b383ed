"""Benchmark decontamination by exact word windows, in built-in expressions only.

Every window of ``n`` consecutive words of a benchmark item (an item with fewer
words is one window) is put into a hash set that travels with the plan; each
document is scanned once, window by window, and a window counts only if its
whole text equals a member, so a hit is verified by the look-up itself. No
document text is shuffled: what leaves the scan is one narrow row per document
and one row per distinct window hit.

The set is bounded (``max_set`` distinct windows). A larger benchmark takes the
other way, with the same result: window texts are joined with the benchmark's
windows on equality, and Spark picks the join.

Defined cases: a null or empty text has no words and no hits; an item without
words has no windows; a null item id is counted as no item, though its windows
still hit; repeated document rows are judged one by one; a document without
hits has ``n_items`` 0 and an empty item list; an empty benchmark hits nothing.
Extra columns pass through ``remove_documents`` and ``remove_spans`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.once import computed_once
from eventloom.llm.registry import query, table
from eventloom.llm.text import lowered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before lower-casing, for cutting the original text.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_SET = 50_000


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _window(words: Column, start: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, window), distinct."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(text_col).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    return (
        items.select(
            "item_id", F.least(F.size("words"), F.lit(n)).alias("size"),
            F.explode(F.transform(starts, lambda i: _window(F.col("words"), i, n))).alias("window"),
        )
        .distinct()
    )


def _starts(size: int) -> Column:
    """Positions at which a window of ``size`` words starts."""
    return F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - (size - 1))).otherwise(F.array().cast("array<int>"))


def _covered(hits: Column) -> Column:
    """Words inside at least one hit; hits are structs (pos, size) in order of pos."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, hit: Column) -> Column:
        stop = (hit["pos"] + hit["size"]).cast("long")
        end = F.greatest(acc["end"], stop)
        return F.struct(end.alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(acc["end"], hit["pos"].cast("long")))).alias("n"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])


def _hits(known: dict[int, list[str]]) -> Column:
    """Windows of ``words`` that are in the set: structs (pos, size) in order."""

    def found(size: int) -> Column:
        hits = F.filter(_starts(size), lambda i: _window(F.col("words"), i, size).isin(known[size]))
        return F.transform(hits, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size")))

    parts = [found(size) for size in sorted(known)]
    return F.array_sort(F.flatten(F.array(*parts))) if parts else F.array().cast("array<struct<pos:int,size:int>>")


def _per_document(docs: DataFrame, windows: DataFrame, max_set: int) -> DataFrame:
    """One row per document row: row_key, n_words, hits, item_ids."""
    sets = windows.select("size", "window").distinct()
    bounded = sets.limit(max_set + 1).collect()
    own = computed_once(docs, "row_key", words=words_of("text"))
    links = windows.select(F.col("item_id").alias("hit_item"), F.col("window").alias("hit_window"))
    if len(bounded) <= max_set:
        known: dict[int, list[str]] = {}
        for row in bounded:
            known.setdefault(row["size"], []).append(row["window"])
        scanned = computed_once(own, "row_key", "words", hits=_hits(known)).select(
            "row_key", F.size("words").cast("long").alias("n_words"), "hits",
            F.array_distinct(F.transform("hits", lambda h: _window(F.col("words"), h["pos"], h["size"]))).alias("windows"),
        )
        # Documents without a hit stay as one row; the others have a row per distinct window.
        pairs = scanned.select("row_key", "n_words", "hits", F.explode_outer("windows").alias("hit_window")).join(links, "hit_window", "left")
        return pairs.groupBy("row_key", "n_words", "hits").agg(F.array_distinct(F.collect_set("hit_item")).alias("items"))
    sizes = [r["size"] for r in sets.select("size").distinct().collect()]  # at most n numbers

    def texts(size: int) -> Column:
        return F.transform(_starts(size), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), _window(F.col("words"), i, size).alias("window")))

    none = F.array().cast("array<struct<pos:int,size:int,window:string>>")
    every = F.flatten(F.array(*[texts(size) for size in sizes])) if sizes else none
    spread = own.select("row_key", F.explode(every).alias("w")).select("row_key", "w.*")
    hit = spread.join(links, spread["window"] == links["hit_window"]).groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.struct("pos", "size"))).alias("hits"), F.collect_set("hit_item").alias("items")
    )
    base = own.select("row_key", F.size("words").cast("long").alias("n_words"))
    return base.join(hit, "row_key", "left").select(
        "row_key", "n_words",
        F.coalesce("hits", F.array().cast("array<struct<pos:int,size:int>>")).alias("hits"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (ids sorted as texts), hits (pos from 1, size), contaminated."""
    keyed = docs.select(F.col("doc_id"), F.col("text"))
    # The id is in the key, so nothing has to be joined back; rows keep their own key even when ids repeat.
    keyed = keyed.select(F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("row")).alias("row_key"), "text")
    found = _per_document(keyed, benchmark_windows(benchmark, n), max_set)
    texts = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("row_key.doc_id").alias("doc_id"), "n_words", _covered(F.col("hits")).alias("n_hit"), texts.alias("items"), "hits"
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _scan_in_row(docs: DataFrame, benchmark: DataFrame, n: int, max_set: int) -> DataFrame | None:
    """``docs`` with a column ``_hits``, or None if the benchmark's windows exceed the set."""
    bounded = benchmark_windows(benchmark, n).select("size", "window").distinct().limit(max_set + 1).collect()
    if len(bounded) > max_set:
        return None
    known: dict[int, list[str]] = {}
    for row in bounded:
        known.setdefault(row["size"], []).append(row["window"])
    own = computed_once(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), "_row", words=words_of(F.col("_row.text")))
    # Once more for the hits, so that a filter on them does not search again.
    return computed_once(own, "_row", _hits=_hits(known))


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int, max_set: int) -> DataFrame:
    found = _scan_in_row(docs, benchmark, n, max_set)
    if found is not None:
        return found
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("row_key"))
    hits = _per_document(own.select("row_key", F.col("_row.text").alias("text")), benchmark_windows(benchmark, n), max_set)
    return own.join(hits.select("row_key", F.col("hits").alias("_hits")), "row_key").select("_row", "_hits")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Documents without any hit, columns as given."""
    return _with_hits(docs, benchmark, n, max_set).where(F.size("_hits") == 0).select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """All documents; every hit word and the gap after it are cut from ``text``."""
    found = _with_hits(docs, benchmark, n, max_set)
    text = F.col("_row.text")
    parts = found.withColumn("_words", F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))).withColumn("_gaps", F.split(text, RAW_WORD, -1))
    inside = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["pos"], h["pos"] + h["size"] - 1))))
    gone = F.map_from_arrays(inside, inside)
    kept = F.transform("_words", lambda w, i: F.when(F.map_contains_key(gone, i + 1), F.lit("")).otherwise(F.concat(w, F.element_at("_gaps", i + 2))))
    cut = F.when(F.size("_hits") == 0, text).otherwise(F.concat(F.element_at("_gaps", 1), F.array_join(kept, "")))
    columns = [cut.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    return parts.select(*columns)


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT win.doc_id, win.n, win.i, g.item_id FROM win JOIN g ON win.gram = g.gram AND win.n = g.n),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items t ON d.doc_id = t.doc_id LEFT JOIN cover c ON d.doc_id = c.doc_id
"""


@query("op1_decontaminate", SQL)
def op1_decontaminate(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
