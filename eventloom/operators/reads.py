"""Lookups and sorted pages.

Only the filters a caller gives become predicates, so they reach the scan;
pages are top-k nodes, never full sorts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.cursor import cursor_text, encode_cursor, position_of
from eventloom.functions.jsontext import iso_text, topic_text
from eventloom.schemas import EVENT_COLUMNS

DEFAULT_LIMIT, MAX_LIMIT = 50, 1000
NFT_KINDS = ("mint", "transfer", "burn")
LIQUIDITY_ACTIONS = ("add", "remove")


def newest_first() -> tuple[Column, Column]:
    return F.col("ledger").desc(), F.col("event_id").desc()


def clamp(limit: int, low: int = 1, high: int = MAX_LIMIT) -> int:
    return max(low, min(limit, high))


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal on every filter that is not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def before(position: tuple[int, str] | None) -> Column | None:
    """Rows after a newest-first position."""
    if position is None:
        return None
    ledger, event_id = position
    return (F.col("ledger") < ledger) | ((F.col("ledger") == ledger) & (F.col("event_id") < event_id))


def page_rows(df: DataFrame, limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    """The page after a cursor, newest first, lazily.

    ``end_cursor`` is each row's own position; ``has_next`` tells whether more
    rows follow the page, read from one extra row.
    """
    size = clamp(limit)
    where = before(position_of(after))
    found = (df if where is None else df.where(where)).orderBy(*newest_first()).limit(size + 1)
    # At most size + 1 rows are left here.
    marked = found.agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ledger", "event_id", *_others(df))))), 1, size).alias("rows"),
        (F.count("*") > size).alias("has_next"),
    )
    row = marked.select(F.explode("rows").alias("r"), "has_next")
    return row.select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns],
        encode_cursor(F.col("r.ledger"), F.col("r.event_id")).alias("end_cursor"),
        "has_next",
    )


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ledger", "event_id")]


def page(df: DataFrame, limit: int = DEFAULT_LIMIT, after: str | None = None) -> tuple[list, str | None]:
    """One page for a caller: its rows (at most 1000) and the next cursor."""
    size = clamp(limit)
    where = before(position_of(after))
    rows = (df if where is None else df.where(where)).orderBy(*newest_first()).limit(size + 1).collect()
    kept = rows[:size]
    more = len(rows) > size
    return kept, cursor_text(kept[-1]["ledger"], kept[-1]["event_id"]) if more else None


def newest(df: DataFrame, limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    where = before(position_of(after))
    return (df if where is None else df.where(where)).orderBy(*newest_first()).limit(clamp(limit))


def page_offset(df: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Page by offset, kept for old callers; a cursor page costs less."""
    return df.orderBy(*newest_first()).offset(max(offset, 0)).limit(clamp(limit))


def _span(df: DataFrame, column: str, low, high) -> DataFrame:
    if low is not None and high is not None and low > high:
        raise ValueError(f"{column}: range start is after its end")
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high))
    return df


def filter_events(
    ev: DataFrame,
    contract_id: str | None = None,
    event_name: str | None = None,
    from_ledger: int | None = None,
    to_ledger: int | None = None,
    since=None,
    until=None,
    topics: Mapping[int, str] | None = None,
    param: tuple[str, str] | None = None,
    enriched_only: bool = False,
) -> DataFrame:
    """``topics`` maps a topic position (0-3) to its text; ``param`` is a
    (name, value) pair of the enriched record."""
    df = matching(ev, contract_id=contract_id, event_name=event_name)
    if enriched_only:
        df = df.where(F.col("enriched").isNotNull())
    df = _span(df, "ledger", from_ledger, to_ledger)
    df = _span(df, "ledger_closed_at", since, until)
    for position, text in (topics or {}).items():
        if position not in range(4):
            raise ValueError("topic position must be 0..3")
        df = df.where(topic_text(F.col("decoded_topics"), position) == F.lit(text))
    if param is not None:
        name, value = param
        record = F.try_variant_get(F.try_parse_json("enriched"), "$.params", "map<string,variant>")
        found = F.try_variant_get(F.try_element_at(record, F.lit(name)), "$.value", "string")
        df = df.where(found == F.lit(value))
    return df


def list_events(ev: DataFrame, contract_id: str, limit: int = DEFAULT_LIMIT, after: str | None = None, **filters) -> DataFrame:
    return newest(filter_events(ev, contract_id, **filters), limit, after)


def get_event(ev: DataFrame, event_id: str) -> DataFrame:
    return matching(ev, event_id=event_id)


def transaction_events(ev: DataFrame, tx_hash: str, limit: int = 100) -> DataFrame:
    """A transaction's events in emission order."""
    return matching(ev, tx_hash=tx_hash).orderBy("ledger", "event_id").limit(clamp(limit))


def list_transfers(tr: DataFrame, contract_id: str | None = None, from_: str | None = None, to: str | None = None,
                   limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    return newest(matching(tr, contract_id=contract_id, from_addr=from_, to_addr=to), limit, after)


def list_swaps(sw: DataFrame, contract_id: str, sender: str | None = None, sell_token: str | None = None,
               buy_token: str | None = None, limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    found = matching(sw, contract_id=contract_id, sender=sender, sell_token=sell_token, buy_token=buy_token)
    return newest(found, limit, after)


def list_nfts(nf: DataFrame, contract_id: str, kind: str | None = None, from_: str | None = None, to: str | None = None,
              token_id: str | None = None, limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    if kind is not None and kind not in NFT_KINDS:
        raise ValueError(f"kind must be one of {NFT_KINDS}")
    found = matching(nf, contract_id=contract_id, event_kind=kind, from_addr=from_, to_addr=to, token_id=token_id)
    return newest(found, limit, after)


def list_liquidity(lq: DataFrame, contract_id: str, kind: str | None = None, provider: str | None = None,
                   limit: int = DEFAULT_LIMIT, after: str | None = None) -> DataFrame:
    if kind is not None and kind not in LIQUIDITY_ACTIONS:
        raise ValueError(f"kind must be one of {LIQUIDITY_ACTIONS}")
    return newest(matching(lq, contract_id=contract_id, event_kind=kind, provider=provider), limit, after)


def list_contracts(summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """Contracts with events, busiest first; ties in id order."""
    ordered = summaries.where("event_count > 0").orderBy(F.col("event_count").desc(), "contract_id")
    return ordered if limit is None else ordered.limit(limit)


def contract_state(st: DataFrame, contract_id: str, limit: int = 1) -> DataFrame:
    return matching(st, contract_id=contract_id).orderBy(F.col("ledger").desc()).limit(clamp(limit, high=200))


def latest_per_key(cd: DataFrame) -> DataFrame:
    """Newest row of every (contract, key): an aggregate, so no key is sorted whole."""
    rest = [c for c in cd.columns if c not in ("contract_id", "key_hash")]
    picked = cd.groupBy("contract_id", "key_hash").agg(F.max_by(F.struct(*rest), "ledger").alias("r"))
    return picked.select(*[F.col(f"r.{c}").alias(c) if c in rest else F.col(c) for c in cd.columns])


def contract_data_latest(cd: DataFrame, contract_id: str, label: str | None = None, limit: int = 100) -> DataFrame:
    found = latest_per_key(matching(cd, contract_id=contract_id, label=label))
    return found.orderBy(F.col("ledger").desc(), "key_hash").limit(clamp(limit))


def contract_data_history(cd: DataFrame, contract_id: str, key_hash: str, limit: int = 1) -> DataFrame:
    """One key's versions newest first; key, durability and label as of the newest."""
    found = matching(cd, contract_id=contract_id, key_hash=key_hash)
    top = found.orderBy(F.col("ledger").desc()).limit(clamp(limit, high=500))
    # At most 500 rows are left, the newest among them.
    tip = F.max_by(F.struct("key", "durability", "label"), "ledger").over(W.partitionBy("contract_id", "key_hash"))
    return top.withColumn("tip", tip).select(
        "contract_id", "key_hash", "tip.key", "tip.durability", "tip.label", "ledger", "value"
    )


def interface(specs: DataFrame, versions: DataFrame, contract_id: str, version: int | None = None) -> DataFrame:
    """Current interface, or the one at a version."""
    if version is None:
        return matching(specs, contract_id=contract_id)
    return matching(versions, contract_id=contract_id, version=version)


def interface_history(versions: DataFrame, contract_id: str, limit: int = 50) -> DataFrame:
    """Versions newest first without their interface bodies."""
    found = matching(versions, contract_id=contract_id).drop("interface", "spec_section")
    return found.orderBy(F.col("version").desc()).limit(clamp(limit, high=200))


def event_json(names=EVENT_COLUMNS) -> Column:
    """An event row as canonical JSON; JSON islands stay JSON."""
    islands = {"decoded_value", "enriched"}

    def part(name: str) -> Column:
        if name in ("ledger_closed_at", "created_at"):
            return iso_text(F.col(name)).alias(name)
        if name in islands:
            return F.try_parse_json(name).alias(name)
        if name == "decoded_topics":
            return F.transform(name, F.try_parse_json).alias(name)
        return F.col(name)

    return F.to_json(F.struct(*[part(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def events_after(ev: DataFrame, contract_id: str, after: tuple[int, str], event_name: str | None = None,
                 limit: int = 100) -> DataFrame:
    """Everything after a position, oldest first, with the row as payload."""
    ledger, event_id = after
    later = (F.col("ledger") > ledger) | ((F.col("ledger") == ledger) & (F.col("event_id") > event_id))
    found = matching(ev, contract_id=contract_id, event_name=event_name).where(later)
    return found.orderBy("ledger", "event_id").limit(limit).select("ledger", "event_id", event_json().alias("payload"))
