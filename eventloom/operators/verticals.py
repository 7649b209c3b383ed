"""Derived tables: one row per qualifying event, pure projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import array_text, text_of, topic, topic_text
from eventloom.functions.once import computed_once
from eventloom.functions.wire import is_address
from eventloom.plans.joins import lookup_join
from eventloom.schemas import TEXT, TEXTS, struct

# Event names of the token and liquidity shapes.
BALANCE_EVENTS = ("transfer", "mint", "burn", "clawback")
LIQUIDITY_KINDS = {
    "deposit": "add", "add_liquidity": "add", "withdraw": "remove", "remove_liquidity": "remove",
}
# Canonical swap body fields.
SWAP_FIELDS = ("sell_amount", "buy_amount")

TOPICS = "decoded_topics"


def _plain(json_text: Column) -> Column:
    """The string inside a JSON string, else the JSON text itself."""
    return F.coalesce(text_of(json_text), json_text)


def token_transfers(ev: DataFrame) -> DataFrame:
    """Balance changes. Mints have no sender, burns and clawbacks no recipient."""
    kind = F.col("event_name")
    first, second = topic_text(TOPICS, 1), topic_text(TOPICS, 2)
    return ev.where(kind.isin(*BALANCE_EVENTS)).select(
        "event_id",
        "contract_id",
        F.when(kind != "mint", first).alias("from_addr"),
        F.when(kind == "transfer", second).when(kind == "mint", first).alias("to_addr"),
        _plain(F.col("decoded_value")).alias("amount"),
        kind.alias("kind"),
        "ledger",
        "ledger_closed_at",
    )


def amm_swaps(
    ev: DataFrame, names: Sequence[str] = ("swap",), fields: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Swaps: topics sell token, buy token and optional sender; body amounts.

    ``fields`` maps a protocol's event name to its (sell, buy) body fields;
    other names use the canonical pair. Rows without both amounts do not have
    the swap shape and are left out.
    """
    fields = fields or {}
    name = F.col("event_name")

    # One parse per event for the fields of all protocols.
    every = dict.fromkeys(f for pair in (SWAP_FIELDS, *fields.values()) for f in pair)
    body = F.from_json("decoded_value", struct(**dict.fromkeys(every, TEXT)))

    def amount(i: int) -> Column:
        found = F.col("_body")[SWAP_FIELDS[i]]
        for protocol, pair in fields.items():
            found = F.when(name == protocol, F.col("_body")[pair[i]]).otherwise(found)
        return found

    return (
        computed_once(
            ev.where(name.isin(*names, *fields)),
            "event_id", "contract_id", "event_name", TOPICS, "ledger", "ledger_closed_at", _body=body,
        )
        .select(
            "event_id",
            "contract_id",
            topic_text(TOPICS, 3).alias("sender"),
            topic_text(TOPICS, 1).alias("sell_token"),
            topic_text(TOPICS, 2).alias("buy_token"),
            amount(0).alias("sell_amount"),
            amount(1).alias("buy_amount"),
            name.alias("raw_event_name"),
            "ledger",
            "ledger_closed_at",
        )
        .where("sell_amount is not null and buy_amount is not null")
    )


# JSON texts of the asset topic (``native`` or ``CODE:ISSUER``) and of an amount.
ASSET_TOPIC = r'\A"(native|[A-Za-z0-9]{1,12}:G[A-Z2-7]{55})"\z'
AMOUNT_BODY = r'\A"-?[0-9]+"\z'


def nft_events(ev: DataFrame, nft_contracts: DataFrame | Sequence[str] | None = None, address_test=is_address) -> DataFrame:
    """Token moves whose last topic is an id.

    Fungible events share the names, so an event counts when its topic count
    fits, the last topic is neither an address nor an asset text and the body
    is not an integer text, or when its contract is a known NFT contract.
    """
    name = F.col("event_name")
    arity = F.when(name == "transfer", 4).when(name.isin("mint", "burn"), 3)
    shaped = ev.where(name.isin("mint", "transfer", "burn")).where(F.size(TOPICS) == arity)
    token = F.when(name == "transfer", topic(TOPICS, 3)).otherwise(topic(TOPICS, 2))
    # Tested on the JSON texts themselves; only address-shaped ids are unpacked.
    unlike_fungible = (
        ~token.rlike(ASSET_TOPIC)
        & ~F.coalesce(F.col("decoded_value").rlike(AMOUNT_BODY), F.lit(False))
        & ~address_test(F.btrim(token, F.lit('"')))
    )
    if nft_contracts is None:
        kept = shaped.where(unlike_fungible)
    elif isinstance(nft_contracts, DataFrame):
        known = nft_contracts.select("contract_id").distinct().withColumn("_nft", F.lit(True))
        kept = lookup_join(shaped, known, ["contract_id"], "left").where(F.col("_nft").isNotNull() | unlike_fungible)
    else:
        kept = shaped.where(F.col("contract_id").isin(list(nft_contracts)) | unlike_fungible)
    first, second = topic_text(TOPICS, 1), topic_text(TOPICS, 2)
    return kept.select(
        "event_id",
        "contract_id",
        name.alias("event_kind"),
        F.when(name != "mint", first).alias("from_addr"),
        F.when(name == "transfer", second).when(name == "mint", first).alias("to_addr"),
        _plain(token).alias("token_id"),
        "ledger",
        "ledger_closed_at",
    )


def liquidity_events(ev: DataFrame) -> DataFrame:
    """Pool deposits and withdrawals; amounts past the second go to JSON."""
    name = F.col("event_name")
    kinds = F.create_map(*[F.lit(x) for pair in LIQUIDITY_KINDS.items() for x in pair])
    # One parse per event into texts.
    texts = struct(amounts=TEXTS, shares_minted=TEXT, shares_burned=TEXT)
    body = F.from_json("decoded_value", texts)
    names = ("event_id", "contract_id", "event_name", TOPICS, "decoded_value", "ledger", "ledger_closed_at")
    kept = computed_once(ev.where(name.isin(*LIQUIDITY_KINDS)), *names, _body=body)
    amounts, added = F.col("_body.amounts"), kinds[name] == "add"
    # Amounts past the second keep their JSON form; few pools have them.
    values = F.try_variant_get(F.try_parse_json("decoded_value"), "$.amounts", "array<variant>")
    rest = F.transform(F.slice(values, F.lit(3), F.size(values) - 2), lambda v: F.to_json(v))
    return kept.select(
        "event_id",
        "contract_id",
        kinds[name].alias("event_kind"),
        topic_text(TOPICS, 1).alias("provider"),
        F.get(amounts, F.lit(0)).alias("amount_a"),
        F.get(amounts, F.lit(1)).alias("amount_b"),
        F.when(added, F.col("_body.shares_minted")).otherwise(F.col("_body.shares_burned")).alias("shares"),
        name.alias("raw_event_name"),
        F.when(F.size(amounts) > 2, array_text(rest)).alias("extra_amounts"),
        "ledger",
        "ledger_closed_at",
    )
