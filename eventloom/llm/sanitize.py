"""Personal data by pattern, and terms that reveal it by co-occurrence.

1. Each text is searched for e-mail addresses, IP addresses, card and phone
   numbers (the entities). For each one the terms within ``WINDOW`` words on
   either side are noted, once per document, with a hash of that context.
2. Over the corpus, a term t and an entity c that meet in ``SUPPORT`` different
   contexts or more are candidates: copies of one context are one piece of
   evidence.
3. The document frequencies of candidates that could pass (their frequency near
   entities alone does not rule them out) are counted over all texts, and a term
   discloses an entity if its pointwise mutual information with it reaches the
   entity's information divided by ``ALPHA``: log p(c|t)/p(c) >= -log p(c) / ALPHA.
4. Disclosing terms are marked wherever they stand, also away from the entity:
   they are removed if nearly every text that has them has the entity
   (p(c|t) >= ``REMOVE``), else generalised.

Which terms to look for in step 3 reaches the tasks as a bitmap of fixed size;
it only picks rows for the exact join that follows. Patterns that fail a check
(parts over 255, digits, Luhn) are dropped without another try.

Defined cases: null text counts as empty, has no spans; rows with equal id and
text are judged alike, and a term counts once for them; a null id is an id like
any other; an empty table gives an empty result; extra columns are not read,
``sanitized`` keeps only doc_id, text and spans. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from eventloom.llm.registry import query, table
from eventloom.llm.text import map_batches, write_read
from eventloom.session import shared_dir

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
WINDOW = 8
SUPPORT = 3
ALPHA = 1.1
REMOVE = 0.95
SHORTEST = 3
BITS = 1 << 24

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never starts inside a run of digits: its start would have matched as well.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\W_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; every start before one @ leads to that @, so each @ is tried once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1, start):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start and kind."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> int:
    """Signed 64-bit name of an entity; its text does not travel."""
    plain = value.lower() if kind == 0 else re.sub(r"[^0-9.]", "", value) if kind == 1 else re.sub(r"[^0-9]", "", value)
    return _long(xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}".encode()))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """(term, entity, context) for the terms around each span, each pair once."""
    out: dict[tuple[str, int], int] = {}
    for start, kind, end in spans:
        # Words around the span, looked for in stretches that grow until enough are found.
        before, reach = [], 200
        while True:
            lo = max(0, start - reach)
            before = [m for m in WORDS.finditer(text, lo, start) if m.start() > lo or lo == 0]
            if len(before) >= WINDOW or lo == 0:
                break
            reach *= 4
        after, reach = [], 200
        while True:
            hi = min(len(text), end + reach)
            after = [m for m in WORDS.finditer(text, end, hi) if m.end() < hi or hi == len(text)]
            if len(after) >= WINDOW or hi == len(text):
                break
            reach *= 4
        around = [m for m in before[-WINDOW:] + after[:WINDOW] if not any(s < m.end() and m.start() < e for s, _, e in spans)]
        words = [m.group().lower() for m in around]
        name = entity(kind, text[start:end])
        context = _long(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")))
        for word in words:
            if len(word) >= SHORTEST:
                out.setdefault((word, name), context)
    return [{"term": t, "entity": e, "context": c} for (t, e), c in out.items()]


SPAN = StructType([StructField("start", IntegerType()), StructField("kind", IntegerType()), StructField("end", IntegerType())])
PAIR = StructType([StructField("term", StringType()), StructField("entity", LongType()), StructField("context", LongType())])


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans, pairs, entities) per row; mark is a hash of the text."""

    def run(cols):
        out = {"doc_id": cols["doc_id"], "mark": cols["mark"], "spans": [], "pairs": [], "entities": []}
        for text in cols["text"]:
            spans = base_spans(text or "")
            out["spans"].append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            out["pairs"].append(contexts(text, spans) if spans else [])
            out["entities"].append(sorted({entity(k, text[s:e]) for s, k, e in spans}))
        return out

    schema = StructType([
        StructField("doc_id", LongType()), StructField("mark", LongType()), StructField("spans", ArrayType(SPAN)), StructField("pairs", ArrayType(PAIR)),
        StructField("entities", ArrayType(LongType())),
    ])
    return map_batches(_marked(docs), run, schema)


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def bitmap(terms: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits set at the terms' hashes; at most bits/64 words reach the driver."""
    place = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(bits))
    words = terms.select(F.floor(place / 64).alias("w"), F.pmod(place, F.lit(64)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["x"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


OCCURRENCE = StructType([
    StructField("doc_id", LongType()), StructField("mark", LongType()), StructField("term", StringType()), StructField("places", ArrayType(IntegerType())),
])


def find_terms(docs: DataFrame, shared, bits: int = BITS) -> DataFrame:
    """(doc_id, mark, term, places) for words whose bit is set; places are starts in code points."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        memo: dict[str, bool] = {}
        for batch in batches:
            out = {"doc_id": [], "mark": [], "term": [], "places": []}
            for doc_id, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hits = []
                for word in set(WORDS.findall(text)):
                    low = word.lower()
                    known = memo.get(low)
                    if known is None:
                        if len(memo) > 400_000:
                            memo.clear()
                        known = memo[low] = len(low) >= SHORTEST and bool(marked[zlib.crc32(low.encode("utf-8", "surrogatepass")) % bits])
                    if known:
                        hits.append(word)
                if hits:
                    wanted = set(hits)
                    places: dict[str, list[int]] = {}
                    for m in WORDS.finditer(text):
                        if m.group() in wanted:
                            places.setdefault(m.group().lower(), []).append(m.start())
                    for term, at in places.items():
                        out["doc_id"].append(doc_id)
                        out["mark"].append(mark)
                        out["term"].append(term)
                        out["places"].append(at)
            if out["term"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["mark"], pa.int64()), pa.array(out["term"], pa.string()), pa.array(out["places"], pa.list_(pa.int32()))],
                    names=["doc_id", "mark", "term", "places"],
                )

    return _marked(docs).mapInArrow(run, OCCURRENCE)


def telling(pairs: DataFrame, base: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows (term, entity, n_both, n_term) whose term discloses the entity, with ``given``, p(entity | term)."""
    whole = base.select("doc_id", "mark").count()
    known = base.where(F.size("entities") > 0).select("doc_id", "mark", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    information = -F.log(F.col("n_entity") / F.lit(float(max(1, whole))))
    mutual = F.log(given) + information
    return pairs.join(known, "entity").where(mutual >= information / F.lit(alpha)).withColumn("given", given)


def disclosures(base: DataFrame, occurrences: DataFrame, candidates: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(term, strength) of terms that disclose some entity; strength is the largest p(c|t)."""
    seen = occurrences.select("doc_id", "mark", "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    return telling(candidates.join(seen, "term"), base, alpha).groupBy("term").agg(F.max("given").alias("strength"))


def find(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, mark, spans) per row; spans are structs (start, kind, end, strength), in order."""
    spark: SparkSession = docs.sparkSession
    folder = shared_dir(spark, "sanitize")
    base = write_read(find_base(docs), f"{folder}/base")
    pairs = base.where(F.size("pairs") > 0).select("doc_id", "mark", F.explode("pairs").alias("p")).select("doc_id", "mark", "p.*")
    by_context = pairs.distinct().groupBy("term", "entity", "context").agg(F.count("*").alias("n"))
    candidates = by_context.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    # A term stands in at least as many documents as near any entity: what cannot disclose by that count is not looked for.
    least = pairs.select("doc_id", "mark", "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    possible = telling(candidates.join(least, "term"), base, alpha)
    candidates = write_read(possible.select("term", "entity", "n_both"), f"{folder}/candidates")
    own = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("strength")))
    marked = base.select("doc_id", "mark", own.alias("spans"))
    shared = spark.sparkContext.broadcast(bitmap(candidates.select("term")))  # BITS bytes
    occurrences = write_read(find_terms(docs, shared), f"{folder}/terms")
    told = disclosures(base, occurrences, candidates, alpha)
    size = F.length("term")
    added = occurrences.join(told, "term").groupBy("doc_id", "mark", "term", "strength").agg(F.first("places").alias("places"))
    added = added.select("doc_id", "mark", F.explode("places").alias("start"), size.alias("size"), "strength")
    added = added.groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct(F.col("start"), F.lit(TERM).alias("kind"), (F.col("start") + F.col("size")).alias("end"), F.col("strength"))).alias("more")
    ).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "more")
    joined = marked.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    # A term inside an entity is covered by it.
    fresh = F.filter(F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int,strength:double>>")),
                     lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return joined.select("doc_id", "mark", F.array_sort(F.concat("spans", fresh)).alias("spans"))


def sanitized(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text, spans): entities and generalised terms replaced by their kind, strong terms removed."""
    found = find(docs, support, alpha).dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    joined = _marked(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))

    def run(cols):
        out = []
        for text, spans in zip(cols["text"], cols["spans"]):
            parts, at = [], 0
            for s in spans:
                if s["end"] <= at:
                    continue
                parts.append(text[at:max(at, s["start"])])
                if s["start"] >= at and not (s["kind"] == TERM and s["strength"] >= remove):
                    parts.append(f"[{KINDS[s['kind']].upper()}]")
                at = s["end"]
            out.append("".join(parts) + text[at:])
        return {"doc_id": cols["doc_id"], "text": out, "spans": cols["spans"]}

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), joined.schema["spans"]])
    return map_batches(joined.select("doc_id", "text", "spans"), run, schema)


@query("op6_sanitize")
def op6_sanitize(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"] != TERM)
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == 0)).cast("long").alias("n_email"), F.size(F.filter("spans", lambda s: s["kind"] == 1)).cast("long").alias("n_ip"),
        F.size(F.filter("spans", lambda s: s["kind"] == 2)).cast("long").alias("n_card"), F.size(F.filter("spans", lambda s: s["kind"] == 3)).cast("long").alias("n_phone"),
    ]
    return found.select("doc_id", *counts, F.sha2(told(own), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
