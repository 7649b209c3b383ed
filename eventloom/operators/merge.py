"""Idempotent appends and re-scan upserts over plain files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Columns a re-scan may change; everything else of a stored event is fixed.
REFRESHED = ("decoded_topics", "decoded_value", "enriched")


def first_copies(incoming: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per event_id; an aggregate, so copies combine map-side.

    The first copy in ``order`` stands; by default the order is the row itself,
    which makes a rerun pick the same copy.
    """
    rest = [c for c in incoming.columns if c != "event_id"]
    row = F.struct(*rest)
    first = F.min(row) if order is None else F.min_by(row, order)
    picked = incoming.groupBy("event_id").agg(first.alias("r"))
    return picked.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in incoming.columns])


def id_marks(stored: DataFrame, incoming: DataFrame) -> tuple[bool, bool]:
    """(repeated, seen): whether an incoming id stands more than once, and whether one is stored.

    One count over the ids alone. Both sides must be files, so that what was
    counted is what is written.
    """
    ids = incoming.select("event_id", F.lit(1).alias("new")).unionAll(stored.select("event_id", F.lit(0).alias("new")))
    per_id = ids.groupBy("event_id").agg(F.sum("new").alias("new"), F.count("*").alias("all")).where("new > 0")
    row = per_id.agg(F.bool_or(F.col("new") > 1).alias("repeated"), F.bool_or(F.col("all") > F.col("new")).alias("seen")).first()
    return bool(row["repeated"]), bool(row["seen"])


def insert_new(stored: DataFrame, incoming: DataFrame, order: Column | None = None, repeated: bool = True, seen: bool = True) -> DataFrame:
    """Incoming rows whose id is not stored. Derived tables are made from these.

    Only the id column of the store is read. Stored ids go first, so that only
    what is new is sorted out among its copies. Where the ids were counted
    (``id_marks``) and none is repeated or stored, that step is left out: whole
    rows are neither shuffled nor sorted by id to find what is not there.
    """
    new = incoming.join(stored.select("event_id"), "event_id", "left_anti").select(*incoming.columns) if seen else incoming
    return first_copies(new, order) if repeated else new


def upsert_events(stored: DataFrame, incoming: DataFrame, order: Column | None = None) -> tuple[DataFrame, Observation]:
    """(merged, stats): known ids refresh decoded content, unknown ids insert.

    ``stats`` fills while the merged rows are written: ``inserted`` and
    ``updated``, known ids whose content really differs. The join runs once.
    """
    stats = Observation()
    merged = _merged(stored, first_copies(incoming, order))
    watched = merged.observe(stats, F.count_if("_inserted").alias("inserted"), F.count_if("_updated").alias("updated"))
    return watched.select(*stored.columns), stats


def _merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    names = stored.columns
    old = stored.select("event_id", F.struct(*names).alias("old"))
    new = incoming.select("event_id", F.struct(*names).alias("new"))
    both = old.join(new, "event_id", "full_outer")
    known = F.col("old").isNotNull() & F.col("new").isNotNull()
    same = F.lit(True)
    for name in REFRESHED:
        same = same & F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))

    def value(name: str) -> Column:
        kept = F.when(F.col("old").isNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        return (F.when(known, F.col(f"new.{name}")).otherwise(kept) if name in REFRESHED else kept).alias(name)

    return both.select(*[value(n) for n in names], F.col("old").isNull().alias("_inserted"), (known & ~same).alias("_updated"))


def seam(archive: DataFrame, live: DataFrame, overlap: tuple[int, int] | None = None) -> DataFrame:
    """Archive and live tail as one history, each id once; archive rows win.

    Two histories that each hold an id once can only repeat one another inside
    the ledgers both cover: with ``overlap`` (first, last ledger) only those
    rows are shuffled and the rest passes through.
    """
    if overlap is not None:
        both = F.col("ledger").between(*overlap)
        middle = seam(archive.where(both), live.where(both))
        return archive.where(~both).unionByName(live.where(~both)).unionByName(middle)
    tagged = archive.withColumn("_source", F.lit(0)).unionByName(live.withColumn("_source", F.lit(1)))
    rest = [c for c in archive.columns if c != "event_id"]
    return first_copies(tagged, F.struct("_source", *rest)).drop("_source")
