"""Mixing sources to target weights by temperature.

Source i with share p_i of all tokens gets the weight p_i^a, normalised. The
exponent a in [0, 1] is bisected (in steps of 64 points, each step one
aggregate over the source table) to the flattest mixture that keeps a target:

* ``max_repeats``: the mixture is scaled so that the source least repeated is
  seen exactly once, and the most repeated one ``max_repeats`` times at most;
  no document is lost, or
* ``entropy``: the largest exponent whose weights reach that entropy (nats).

The weights are realised as budgeted block permutations. Each epoch of a
source deals its documents into blocks by a hash; the blocks, in an order of
their own for each epoch, are taken until the source's token budget is met.
Full epochs take every document. In the last, partial epoch only block sums
are ordered along a source; documents are ordered inside the one block that
crosses the budget, up to the first document that reaches it. So a source with
a third of all rows is no single sort.

Defined cases: a null source is a source of its own; null and empty texts have
no tokens, never count towards a budget, and are kept in every full epoch; an
empty table gives an empty result; repeated rows count as rows; other columns
pass through. Tokens are words between white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.registry import query, table
from eventloom.llm.text import write_read
from eventloom.session import shared_dir

MAX_REPEATS = 1.5
SEED = 7
# Tokens a block should hold on average.
BLOCK_TOKENS = 200_000
# Blocks grow with the corpus beyond this number, so their table stays small.
MAX_BLOCKS = 100_000
GRID = 64
ROUNDS = 4


def token_count(text: Column | str) -> Column:
    """Words between ASCII white space."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs); aggregates combine before the shuffle, so a hot source is one row per task."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sizes: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent that meets the target; each round halves the interval six times over in one aggregate."""
    sized = sizes.where("tokens > 0")
    total = sized.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    share = sized.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0  # every target holds at one end: repeats at 1, entropy at 0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        columns = []
        for i, a in enumerate(points):
            w = F.pow("p", F.lit(a))
            columns.append(F.sum(w).alias(f"z{i}"))
            if entropy is None:
                columns.append((F.max(w / F.col("p")) / F.min(w / F.col("p"))).alias(f"t{i}"))
            else:
                columns.append(F.sum(w * F.log(w)).alias(f"t{i}"))
        row = share.agg(*columns).first()
        if entropy is None:
            good = [row[f"t{i}"] <= max_repeats * (1 + 1e-12) for i in range(GRID + 1)]
            first = good.index(True) if any(good) else GRID
            low, high = points[max(0, first - 1)], points[first]
        else:
            value = [_entropy(row[f"z{i}"], row[f"t{i}"]) for i in range(GRID + 1)]
            good = [v >= entropy - 1e-12 for v in value]
            last = max((i for i, ok in enumerate(good) if ok), default=0)
            low, high = points[last], points[min(GRID, last + 1)]
    return high if entropy is None else low


def _entropy(z: float, wlogw: float) -> float:
    """Entropy of weights w/z from z and the sum of w log w."""
    import math

    return math.log(z) - wlogw / z


def plan(sizes: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, tokens, docs, weight, repeats): epochs each source is seen, 1 for sources without tokens.

    Without a token ``budget`` the least repeated source is seen exactly once.
    """
    a = exponent(sizes, max_repeats, entropy)
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    weighed = sizes.withColumn("_raw", raw)
    z = weighed.agg(F.sum("_raw")).first()[0] or 1.0
    weighed = weighed.withColumn("weight", F.col("_raw") / F.lit(float(z))).drop("_raw")
    per_token = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    if budget is None:
        least = weighed.agg(F.min(per_token)).first()[0]
        budget = 1.0 / least if least else 0.0
    return weighed.withColumn("repeats", F.coalesce(per_token * F.lit(float(budget)), F.lit(1.0)))


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None,
        seed: int = SEED, block_tokens: int = BLOCK_TOKENS, epoch: str = "_epoch") -> DataFrame:
    """Rows of ``docs`` once per epoch in which they are taken, with the column ``epoch`` (from 1) added."""
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark, "mixing")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Maps and variants have no hash; the other columns place a row.
    key = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    # Narrow rows decide; they are written once, and texts are never shuffled.
    narrow = write_read(docs.select("source", key.alias("key"), token_count("text").alias("tokens")), f"{base}/rows")
    plans = write_read(plan(source_sizes(narrow), max_repeats, entropy, budget), f"{base}/plan")
    total = plans.agg(F.sum("tokens")).first()[0] or 0
    per_block = max(block_tokens, total // MAX_BLOCKS)
    # Two orders of a document: the block it falls into, and its place inside.
    full = F.floor(F.col("repeats") + 1e-9)
    parted = plans.select(
        F.col("source").alias("_source"), full.cast("int").alias("_full"), ((F.col("repeats") - full) * F.col("tokens")).alias("_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(per_block))).cast("long").alias("_blocks"),
    )
    parted = F.broadcast(parted) if _few(parted) else parted
    block = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("_blocks"))
    place = F.struct(F.xxhash64("key", F.lit(seed + 2)).alias("h"), F.col("key").alias("k"))

    rows = narrow.join(parted, F.col("source").eqNullSafe(F.col("_source"))).where("_quota > 0 and tokens > 0").select("_source", "_quota", "key", "tokens", block.alias("_block"))
    sums = rows.groupBy("_source", "_quota", "_block").agg(F.sum("tokens").alias("in_block"))
    along = Window.partitionBy("_source").orderBy(F.xxhash64("_block", F.lit(seed + 1)), "_block").rowsBetween(Window.unboundedPreceding, -1)
    reached = write_read(sums.withColumn("before", F.coalesce(F.sum("in_block").over(along), F.lit(0))).where("before < _quota"), f"{base}/blocks")
    whole = reached.where("before + in_block <= _quota").select("_source", "_block", F.lit(None).cast("struct<h:bigint,k:bigint>").alias("_last"))
    crossing = reached.where("before + in_block > _quota").select(F.col("_source").alias("_of"), F.col("_block").alias("_at"), "before")
    inside = Window.partitionBy("_source", "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    part = rows.join(F.broadcast(crossing) if _few(crossing) else crossing, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    part = part.withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where("ahead < _quota")
    last = part.groupBy("_source", "_block").agg(F.max(place).alias("_last"))
    taken = write_read(whole.unionByName(last), f"{base}/taken").select(F.col("_source").alias("_of"), F.col("_block").alias("_at"), "_last", F.lit(1).alias("_in"))

    own = docs.select(F.struct(*columns).alias("_row"), key.alias("key"), F.col("source"), (token_count("text") > 0).alias("_counts"))
    own = own.join(parted, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_block", block)
    own = own.join(F.broadcast(taken) if _few(taken, MAX_BLOCKS * 2) else taken, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")), "left")
    extra = F.coalesce((F.col("_in") == 1) & F.col("_counts") & (F.col("_last").isNull() | (place <= F.col("_last"))), F.lit(False))
    epochs = F.col("_full") + extra.cast("int")
    # Rows with equal values share their place: all of them are taken when one is.
    return own.where(epochs > 0).select("_row.*", F.explode(F.sequence(F.lit(1), epochs)).alias(epoch))


def _few(frame: DataFrame, rows: int = 50_000) -> bool:
    """Whether a table of narrow rows is small enough to broadcast."""
    return frame.limit(rows + 1).count() <= rows


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    """Source, document and epoch of the mixture."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs)
    return mixed.select("doc_id", "source", F.col("_epoch").cast("int").alias("epoch"), token_count("text").alias("n_tokens"))
