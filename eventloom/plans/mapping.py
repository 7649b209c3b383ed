"""The driver's tables seen as event-analytics tables.

Pure projections: no row is dropped or sampled, so every query over them grows
with the given data. The SQL twins of these views are in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import wire
from eventloom.functions.ids import event_id_at
from eventloom.plans.joins import lookup_join

# Fixed values of the mapping.
NAMES = {"purchase": "transfer", "signup": "mint", "click": "burn", "error": "clawback"}
WIRE_CONTRACTS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def quote(col: Column) -> Column:
    """JSON string of a text that needs no escapes, as all mapped texts do."""
    return F.concat(F.lit('"'), col, F.lit('"'))


def _name(event_type: Column) -> Column:
    mapped = None
    for given, name in NAMES.items():
        mapped = F.when(event_type == given, name) if mapped is None else mapped.when(event_type == given, name)
    return mapped


def _ledger(ts) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(5))


def _cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def padded(col: str, width: int) -> Column:
    return F.lpad(text(col), width, "0")


def events_from(e: DataFrame) -> DataFrame:
    """Rows of the driver's event table as decoded events (also for streams)."""
    name = _name(F.col("event_type"))
    amount = text(_cents("value"))
    first = F.concat(F.lit("G"), text("user_id"))
    second = F.concat(F.lit("G"), text((F.col("user_id") * 7 + F.col("event_id")) % 100))
    k = F.get_json_object("props", "$.k")
    record = F.concat(
        F.lit('{"event":'), quote(F.coalesce(name, F.lit("view"))), F.lit(',"params":{"k":{"type":"u32","value":'), quote(k), F.lit("}}}")
    )
    at = F.col("ts").cast("timestamp")
    return e.select(
        padded("event_id", 12).alias("event_id"),
        F.concat(F.lit("C"), F.lpad(text(F.col("user_id") % 10), 3, "0")).alias("contract_id"),
        _ledger("ts").alias("ledger"),
        at.alias("ledger_closed_at"),
        F.lit("contract").alias("event_type"),
        F.array().cast("array<string>").alias("topics"),
        # An unnamed event starts with a number, which is no name.
        F.array(F.coalesce(quote(name), F.lit("7")), quote(first), quote(second)).alias("decoded_topics"),
        name.alias("event_name"),
        F.lit("").alias("value"),
        quote(amount).alias("decoded_value"),
        F.when(F.col("event_id") % 4 != 0, record).alias("enriched"),
        F.concat(F.lit("tx"), text(F.floor(F.col("event_id") / 3))).alias("tx_hash"),
        (F.col("event_type") != "error").alias("in_successful_call"),
        padded("event_id", 12).alias("paging_token"),
        at.alias("created_at"),
    )


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from(table(spark, sf_dir, "events"))


def encoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events under ids that encode their ledger."""
    own = event_id_at(F.col("ledger"), F.col("event_id").cast("bigint"), F.lit(0))
    return ev(spark, sf_dir).withColumns({"event_id": own, "paging_token": own})


def _line_base(li: DataFrame) -> DataFrame:
    return li.select(
        "*",
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("event_id"),
        F.concat(F.lit("C"), text(F.col("l_suppkey") % 10)).alias("contract_id"),
        _ledger("l_shipdate").alias("ledger"),
        F.col("l_shipdate").cast("timestamp").alias("ledger_closed_at"),
        _cents("l_extendedprice").alias("_price"),
        _cents("l_quantity").alias("_qty"),
        F.concat(F.lit("P"), text("l_partkey")).alias("_p"),
        F.concat(F.lit("S"), text("l_suppkey")).alias("_s"),
        F.concat(F.lit("U"), text("l_orderkey")).alias("_u"),
    )


EVENT_PART = ("event_id", "contract_id", "ledger", "ledger_closed_at")


def swap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap-shaped events: canonical (flag A), a protocol variant (N), other names."""
    b = _line_base(table(spark, sf_dir, "lineitem"))
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "swap").when(flag == "N", "trade").otherwise("sync")
    pair = lambda sell, buy: F.concat(
        F.lit(f'{{"{buy}":"'), text("_qty"), F.lit(f'","{sell}":"'), text("_price"), F.lit('"}')
    )
    body = F.when(flag == "N", pair("amount_in", "amount_out")).otherwise(pair("sell_amount", "buy_amount"))
    topics = F.array(quote(name), quote(F.col("_p")), quote(F.col("_s")))
    return b.select(
        *EVENT_PART,
        name.alias("event_name"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(topics, F.array(quote(F.col("_u"))))).otherwise(topics).alias("decoded_topics"),
        body.alias("decoded_value"),
    )


def nft_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token moves, some fungible: integer bodies and asset topics."""
    b = _line_base(table(spark, sf_dir, "lineitem"))
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    name = F.when(flag == "A", "mint").when(flag == "N", "transfer").otherwise("burn")
    token = (
        F.when(n % 3 == 0, F.lit('"native"'))
        .when(n % 3 == 1, text("l_partkey"))
        .otherwise(F.concat(F.lit('{"id":'), text("l_partkey"), F.lit("}")))
    )
    topics = F.when(
        flag == "N", F.array(quote(name), quote(F.col("_u")), quote(F.col("_s")), token)
    ).otherwise(F.array(quote(name), quote(F.col("_u")), token))
    return b.select(
        *EVENT_PART,
        name.alias("event_name"),
        topics.alias("decoded_topics"),
        F.when(n % 5 == 0, quote(text("_qty"))).otherwise(F.lit("null")).alias("decoded_value"),
    )


def liquidity_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool events with one to three amounts."""
    b = _line_base(table(spark, sf_dir, "lineitem"))
    n = F.col("l_linenumber")
    name = (
        F.when(n % 4 == 0, "deposit").when(n % 4 == 1, "withdraw").when(n % 4 == 2, "add_liquidity").otherwise("remove_liquidity")
    )
    parts = F.slice(F.array(quote(text("_price")), quote(text("_qty")), quote(text("l_partkey"))), F.lit(1), n % 3 + 1)
    shares = F.when(n % 2 == 0, F.lit("shares_minted")).otherwise(F.lit("shares_burned"))
    body = F.concat(
        F.lit('{"amounts":['), F.array_join(parts, ","), F.lit('],"'), shares, F.lit('":"'), text("l_suppkey"), F.lit('"}')
    )
    return b.select(
        *EVENT_PART, name.alias("event_name"), F.array(quote(name), quote(F.col("_u"))).alias("decoded_topics"), body.alias("decoded_value")
    )


def contract_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("G"), text("user_id"))
    return e.select(
        F.concat(F.lit("C"), F.lpad(text(F.col("user_id") % 10), 3, "0")).alias("contract_id"),
        F.sha2(key.cast("binary"), 256).alias("key_hash"),
        quote(key).alias("key"),
        # A key's newest ledger must be unique; event ids break ledger ties.
        (_ledger("ts") * 10 + F.col("event_id") % 10).alias("ledger"),
        F.when(F.col("event_type").isin("purchase", "signup"), "balance").otherwise("allowance").alias("label"),
        F.lit("persistent").alias("durability"),
        quote(text(_cents("value"))).alias("value"),
    )


def contract_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State snapshots: one per contract and ledger, largest value kept."""
    e = ev(spark, sf_dir).where("event_name = 'mint'")
    return e.groupBy("contract_id", "ledger").agg(F.max("decoded_value").alias("storage"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(
        F.concat(F.lit("C"), F.lpad(text(F.col("user_id") % 10), 3, "0")).alias("contract_id"),
        F.concat(F.lit("h"), text(F.get_json_object("props", "$.k").cast("int") % 3)).alias("wasm_hash"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("obs_id"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface items per contract (brand) and version."""
    p = table(spark, sf_dir, "part")
    section = F.when(F.col("p_partkey") % 3 == 0, "functions").when(F.col("p_partkey") % 3 == 1, "events").otherwise("types")
    rows = p.select(
        F.col("p_brand").alias("contract_id"),
        (F.col("p_size") % 3 + 1).alias("version"),
        section.alias("section"),
        F.col("p_type").alias("name"),
        F.concat("p_type", F.lit("("), text(F.col("p_size") % 5), F.lit(")")).alias("signature"),
    )
    return rows.groupBy("contract_id", "version", "section", "name").agg(F.min("signature").alias("signature"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    upgrade = k % 5 == 0
    return table(spark, sf_dir, "nation").select(
        text(k).alias("id"),
        F.concat(F.lit("https://hooks.example/"), F.col("n_name")).alias("url"),
        F.when(upgrade, "upgrade").otherwise("event").alias("kind"),
        F.when(k % 3 != 0, F.concat(F.lit("C"), F.lpad(text(k % 10), 3, "0"))).alias("contract_id"),
        F.when(upgrade | (k % 2 == 0), F.lit(None)).when(k % 4 == 1, "transfer").otherwise("mint").alias("event_name"),
        F.concat(F.lit("secret-"), text(k)).alias("secret"),
        (k % 7 != 0).alias("active"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k * 60).alias("created_at"),
        F.when(k % 7 == 0, F.timestamp_seconds(F.lit(1_710_000_000) + k)).alias("auto_disabled_at"),
        F.when(k % 7 == 0, F.lit("manual")).alias("auto_disabled_reason"),
        (k % 4).cast("int").alias("consecutive_failures"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("delivered")
    upgrade = key % 10 == 0
    return o.select(
        key.alias("id"),
        text(F.col("o_custkey") % 25).alias("subscription_id"),
        F.when(~upgrade, F.lpad(text(key), 12, "0")).alias("event_id"),
        F.when(upgrade, key).alias("upgrade_id"),
        status.alias("status"),
        (key % 7).cast("int").alias("attempts"),
        F.when(status == "failed", F.lit("non-2xx status 500")).alias("last_error"),
        F.timestamp_seconds(F.unix_seconds(day) + key % 48 * 3600).alias("next_attempt_at"),
        F.when(status == "delivered", F.timestamp_seconds(F.unix_seconds(day) + 30)).alias("delivered_at"),
        day.alias("created_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deliveries(spark, sf_dir).where("status = 'pending'")
    ok = F.col("id") % 3 == 0
    return d.select(
        F.col("id").alias("delivery_id"),
        "subscription_id",
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("non-2xx status "), text(500 + F.col("id") % 4))).alias("error"),
        F.col("next_attempt_at").alias("at"),
    )


def upgrade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface versions as a table with ids, one per order that is an upgrade."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.where(key % 10 == 0).select(
        key.alias("id"),
        F.concat(F.lit("C"), F.lpad(text(F.col("o_custkey") % 10), 3, "0")).alias("contract_id"),
        (key % 50 / 10 + 1).cast("int").alias("version"),
        F.concat(F.lit("h"), text(key)).alias("wasm_hash"),
        F.concat(F.lit("h"), text(key - 10)).alias("previous_wasm_hash"),
        (key % 3 == 0).alias("breaking"),
        F.when(key % 4 == 0, F.lit('{"breaking":false}')).alias("diff"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("/contracts/"), text("user_id"), F.lit("/"), F.col("event_type")).alias("path"),
        F.lit("GET").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples per minute and instance, reset at each day's start."""
    e = table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    per_minute = e.groupBy(F.concat(F.lit("i"), text(F.col("user_id") % 2)).alias("instance"), minute.alias("at")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("e"),
        F.count_if(F.col("event_type") == "view").alias("r"),
        F.max(F.floor(F.col("value") * 10)).alias("lag"),
    )
    from pyspark.sql import Window as W

    # A day per window: the counters start anew each day, as after a restart.
    upto = W.partitionBy("instance", F.to_date("at")).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_minute.select(
        "instance", "at",
        F.sum("n").over(upto).alias("ingested"), F.sum("e").over(upto).alias("errors"), F.sum("r").over(upto).alias("requests"), "lag",
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingest cycle per driver event."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("cycle_id"),
        F.col("ts").cast("timestamp").alias("at"),
        _ledger("ts").alias("last_ledger"),
        (_ledger("ts") + n % 150).alias("tip_ledger"),
        (n % 17).alias("ingested"),
        (F.col("event_type") == "error").cast("bigint").alias("errors"),
        (n % 11).alias("enriched"),
        (n % 6).alias("not_enriched"),
        (n % 2).alias("spec_failures"),
        (n % 5 + 1).alias("rpc_calls"),
        (n % 3).alias("rpc_errors"),
        (n % 13 == 0).cast("bigint").alias("rpc_errors_range"),
    )


# ---- wire form --------------------------------------------------------------


def _account(seed: Column) -> Column:
    """An account address value whose 32-byte key is the hash of ``seed``."""
    return F.concat(F.lit("00000012" + "0" * 16), F.upper(F.sha2(seed.cast("binary"), 256)))


def wire_contract_key(n: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit("contract-"), text(n)).cast("binary"), 256))


def wire_contracts(spark: SparkSession) -> DataFrame:
    """Key text of every contract number a user id can give; written once each, not once per event."""
    numbers = spark.range(1 - WIRE_CONTRACTS, WIRE_CONTRACTS, 1, 1).withColumnRenamed("id", "contract_no")
    return numbers.select("contract_no", wire.strkey(wire.CONTRACT_VERSION, wire_contract_key(F.col("contract_no"))).alias("contract_id"))


def raw_from(e: DataFrame) -> DataFrame:
    """Driver events as undecoded source rows: base64 topics and bodies.

    The body layout follows the contract: one value, a list or a map.
    """
    n = F.col("user_id") % WIRE_CONTRACTS
    name = _name(F.col("event_type"))
    cents = _cents("value")
    signed = F.when(F.col("event_type") == "error", -cents).otherwise(cents)
    head = F.when(name.isNotNull(), wire.hex_symbol(name)).otherwise(F.lit("0000000300000007"))
    status = F.concat(F.lit("00000003"), wire.hex_u32(F.col("event_id") % 4))
    listed = F.concat(F.lit("000000100000000100000002"), wire.hex_i128(signed), status)
    mapped = F.concat(
        F.lit("000000110000000100000002"), wire.hex_symbol(F.lit("amount")), wire.hex_i128(signed),
        wire.hex_symbol(F.lit("status")), status,
    )
    body = F.when(n % 3 == 0, wire.hex_i128(signed)).when(n % 3 == 1, listed).otherwise(mapped)
    topics = F.array(
        head,
        _account(F.concat(F.lit("G"), text("user_id"))),
        _account(F.concat(F.lit("G"), text((F.col("user_id") * 7 + F.col("event_id")) % 100))),
    )
    rows = e.select(
        padded("event_id", 12).alias("event_id"),
        n.alias("contract_no"),
        _ledger("ts").alias("ledger"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ledger_closed_at"),
        F.lit("contract").alias("event_type"),
        F.transform(topics, wire.base64_of).alias("topics"),
        wire.base64_of(body).alias("value"),
        F.concat(F.lit("tx"), text(F.floor(F.col("event_id") / 3))).alias("tx_hash"),
        (F.col("event_type") != "error").alias("in_successful_call"),
        F.lit("").alias("paging_token"),
    )
    named = lookup_join(rows, wire_contracts(e.sparkSession), ["contract_no"], "left", few=True)
    return named.select("event_id", "contract_no", "contract_id", *rows.columns[2:])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All driver events, spread while they are narrow rows.

    Their file has few row groups, so that without it one task or two would
    write and decode a whole table while the other cores wait.
    """
    return raw_from(table(spark, sf_dir, "events").repartition("event_id"))


def page_lines_from(e: DataFrame) -> DataFrame:
    """One saved listing page per driver event (column ``value``)."""
    r = raw_from(e)
    entry = F.struct(
        F.col("event_type").alias("type"), "ledger", F.col("ledger_closed_at").alias("ledgerClosedAt"),
        F.col("contract_id").alias("contractId"), F.col("event_id").alias("id"),
        # The flag is left out of failed calls, where it defaults to false.
        F.when(F.col("in_successful_call"), F.lit(True)).alias("inSuccessfulContractCall"),
        F.col("tx_hash").alias("txHash"), F.col("topics").alias("topic"), "value",
    )
    return r.select(F.to_json(F.struct(F.col("ledger").alias("latestLedger"), F.array(entry).alias("events"))).alias("value"))


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History lines with the ledger they were written in: flat records, envelopes, bad lines and comments by event id."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    ledger = text(_ledger("ts"))
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    contract = F.concat(F.lit("C"), text(F.col("user_id") % 10))
    flat = F.concat(
        F.lit('{"id":"e'), text(n), F.lit('","contract_id":"'), contract, F.lit('","ledger":'), ledger,
        F.lit(',"ledger_closed_at":"'), at, F.lit('","paging_token":"p'), text(n), F.lit('","tx_hash":"t","topic":["AAAADwAAAANmZWUA"]}'),
    )
    envelope = F.concat(
        F.lit('{"ledger":'), ledger, F.lit(',"ledger_close_time":"'), at, F.lit('","events":[{"event_id":"e'), text(n),
        F.lit('","id":"other","contract_id":"'), contract, F.lit('","in_successful_contract_call":false},'),
        F.lit('{"id":"x'), text(n), F.lit('","contract_id":"'), contract, F.lit('","type":"system"},{"contract_id":"CX"}]}'),
    )
    line = (
        F.when(n % 10 == 1, "{not valid json}")
        .when(n % 10 == 2, F.concat(F.lit("  # note "), text(n)))
        .when(n % 10 == 3, F.concat(F.lit('{"id":"e'), text(n), F.lit('","ledger":1}')))
        .when(n % 10 == 4, F.concat(F.lit('{"ledger":"'), ledger, F.lit('","events":[]}')))
        .when(n % 2 == 0, flat)
        .otherwise(F.concat(F.lit(" "), envelope, F.lit(" ")))
    )
    return e.select(_ledger("ts").alias("ledger"), line.alias("value"))


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_lines(spark, sf_dir).select("value")


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger-entry dumps: an instance or a data entry per driver event."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    contract = F.concat(F.lit("C"), text(F.col("user_id") % 10))
    amount = wire.base64_of(wire.hex_i128(_cents("value")))
    key = wire.base64_of(wire.hex_symbol(F.concat(F.lit("key"), text("user_id"))))
    ledger = _ledger("ts").alias("last_modified_ledger")
    instance = F.to_json(F.struct(contract.alias("contract_id"), F.lit("h").alias("wasm_hash"), amount.alias("storage"), ledger))
    data = F.to_json(
        F.struct(contract.alias("contract_id"), key.alias("key"), F.lit("Temporary").alias("durability"), amount.alias("val"), ledger)
    )
    return e.select(F.when(n % 2 == 0, instance).otherwise(data).alias("value"))


# ---- interfaces -------------------------------------------------------------


def _hex_texts(value: str) -> str:
    raw = value.encode()
    return len(raw).to_bytes(4, "big").hex().upper() + raw.hex().upper() + "00" * (-len(raw) % 4)


_EMPTY = "00000000"
# Type tags used below.
U32, I128, ADDRESS = "00000004", "0000000B", "00000013"
VEC_OF = "000003EA"
KIND_ENUM = "Kind"
_KIND_TYPE = "000007D0" + _hex_texts(KIND_ENUM)
_KIND_ENTRY = (
    "00000003" + _EMPTY + _EMPTY + _hex_texts(KIND_ENUM) + "00000003"
    + "".join(_EMPTY + _hex_texts(n) + i.to_bytes(4, "big").hex() for i, n in enumerate(("Low", "Mid", "High")))
)


def _param(name: str, kind: str, location: int) -> str:
    return _EMPTY + _hex_texts(name) + kind + location.to_bytes(4, "big").hex()


def _event_entry(name: str, prefix: str, params: list[str], data_format: Column) -> Column:
    head = "00000005" + _EMPTY + _EMPTY + _hex_texts(name) + "00000001" + _hex_texts(prefix)
    return F.concat(F.lit(head + len(params).to_bytes(4, "big").hex() + "".join(params)), wire.hex_u32(data_format))


def _module(section_hex: Column) -> Column:
    """A module with one custom section in front of the interface section."""

    def length(n: Column) -> Column:
        # Two base-128 digits are enough for these sections.
        low = (n % 128 + 128).cast("bigint")
        return F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(F.floor(n / 128)), 2, "0"))

    name = b"contractspecv0"
    named = F.concat(F.lit(f"{len(name):02X}" + name.hex().upper()), section_hex)
    other = "00" + "05" + "03" + b"abc".hex() + "FF"
    return F.unhex(F.concat(F.lit("0061736D01000000" + other + "00"), length(F.length(named) / 2), named))


def part_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per part: one function, one event, one struct.

    A part is few bytes in and much work to read as a module, so parts are
    spread before: their file is one split or two for long.
    """
    p = table(spark, sf_dir, "part").repartition("p_partkey")
    key, size = text("p_partkey"), F.col("p_size") % 3
    name = F.concat(F.lit("f"), key)
    inputs = _EMPTY + _hex_texts("to") + ADDRESS + _EMPTY + _hex_texts("amount") + I128
    outputs = F.when(size == 0, F.lit(_EMPTY)).when(size == 1, F.lit("00000001" + U32)).otherwise(F.lit("00000001" + VEC_OF + _KIND_TYPE))
    function = F.concat(
        F.lit("00000000"), wire.hex_text(F.col("p_name")), wire.hex_text(name), F.lit("00000002" + inputs), outputs
    )
    event = F.concat(
        F.lit("00000005" + _EMPTY + _EMPTY), wire.hex_text(F.concat(F.lit("Made"), key)), F.lit("00000001"),
        wire.hex_text(F.lower("p_type")), F.lit("00000002" + _param("who", ADDRESS, 1) + _param("n", U32, 0)), wire.hex_u32(size),
    )
    struct = F.concat(
        F.lit("00000001" + _EMPTY + _EMPTY), wire.hex_text(F.concat(F.lit("T"), key)), F.lit("00000001" + _EMPTY + _hex_texts("k") + _KIND_TYPE)
    )
    # A trailing unreadable entry must not spoil what came before it.
    body = F.concat(function, event, struct, F.lit(_KIND_ENTRY + "000000FF"))
    return p.select(
        F.concat(F.lit("M"), key).alias("contract_id"), body.alias("section_hex"), _module(body).alias("content")
    )


def wire_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface sections of the wire contracts, one per nation row."""
    k = F.col("n_nationkey")
    topics = [_param("from", ADDRESS, 1), _param("to", ADDRESS, 1)]
    amount, status = _param("amount", I128, 0), _param("status", _KIND_TYPE, 0)
    layout = k % 3
    both = _event_entry("Transfer", "transfer", [*topics, amount, status], layout)
    single = _event_entry("Transfer", "transfer", [*topics, amount], layout)
    minted = F.when(layout == 0, _event_entry("mint", "mint", [_param("to", ADDRESS, 1), amount], layout)).otherwise(
        _event_entry("mint", "mint", [_param("to", ADDRESS, 1), amount, status], layout)
    )
    body = F.concat(F.lit(_KIND_ENTRY), F.when(layout == 0, single).otherwise(both), minted)
    return table(spark, sf_dir, "nation").select(
        wire.strkey(wire.CONTRACT_VERSION, wire_contract_key(k)).alias("contract_id"), F.unhex(body).alias("section")
    )
