"""Wire values, interfaces and enrichment, on values Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import signing, wire
from eventloom.functions.interface import parse_interface, relabel, spec_section
from eventloom.functions.once import computed_once
from eventloom.operators import discovery, interfaces as I
from eventloom.operators.convert import to_events
from eventloom.operators.enrich import reenrich
from eventloom.operators.typed import typed_events
from eventloom.plans import mapping as M
from eventloom.plans.catalog import counted, query, stamp
from eventloom.plans.oracle import stamp as sql_stamp
from eventloom.plans.oracle import strkey_ctes, with_views

ACCOUNT_SEEDS = (
    "SELECT s AS k, '30' || sha256(s) AS hx FROM (SELECT DISTINCT 'G' || user_id AS s FROM events "
    "UNION SELECT DISTINCT 'G' || ((user_id * 7 + event_id) % 100) FROM events)"
)
CONTRACT_SEEDS = (
    "SELECT CAST(n AS VARCHAR) AS k, '10' || sha256('contract-' || n) AS hx FROM (SELECT DISTINCT user_id % 25 AS n FROM events)"
)
ACCOUNTS = strkey_ctes(ACCOUNT_SEEDS, "accounts")
CONTRACTS = strkey_ctes(CONTRACT_SEEDS, "contracts")

# Driver events with the texts their wire form should decode to.
WIRE = f"""{ACCOUNTS}, {CONTRACTS}, wired AS (SELECT e.event_id AS n, lpad(CAST(e.event_id AS VARCHAR), 12, '0') AS event_id,
  c.txt AS contract_id, e.user_id % 25 AS no, CAST(floor(epoch(ts) / 5) AS BIGINT) AS ledger, ts,
  CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'mint' WHEN 'click' THEN 'burn' WHEN 'error' THEN 'clawback' END AS event_name,
  a.txt AS t1, b.txt AS t2, CAST(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount,
  e.event_id % 4 AS status FROM events e JOIN contracts c ON c.k = CAST(e.user_id % 25 AS VARCHAR)
  JOIN accounts a ON a.k = 'G' || e.user_id JOIN accounts b ON b.k = 'G' || ((e.user_id * 7 + e.event_id) % 100))"""

BODY = """CASE no % 3 WHEN 0 THEN '"' || amount || '"' WHEN 1 THEN '["' || amount || '",' || status || ']'
  ELSE '{"amount":"' || amount || '","status":' || status || '}' END"""
TOPICS = """'[' || coalesce('"' || event_name || '"', '7') || ',"' || t1 || '","' || t2 || '"]'"""

STATUS = "CASE status WHEN 0 THEN '\"Low\"' WHEN 1 THEN '\"Mid\"' WHEN 2 THEN '\"High\"' ELSE '3' END"


def _param(name: str, kind: str, value: str) -> str:
    return f"""'"{name}":{{"type":"{kind}","value":' || {value} || '}}'"""


_AMOUNT = _param("amount", "i128", "'\"' || amount || '\"'")
_STATUS = "CASE WHEN no % 3 = 0 THEN '' ELSE ',' || " + _param("status", "Kind", STATUS) + " END"
ENRICHED = f"""CASE event_name WHEN 'transfer' THEN '{{"event":"Transfer","params":{{' || {_AMOUNT} || ',' ||
  {_param("from", "Address", "'\"' || t1 || '\"'")} || {_STATUS} || ',' || {_param("to", "Address", "'\"' || t2 || '\"'")} || '}}}}'
  WHEN 'mint' THEN '{{"event":"mint","params":{{' || {_AMOUNT} || {_STATUS} || ',' || {_param("to", "Address", "'\"' || t1 || '\"'")} || '}}}}' END"""


def _interfaces(spark, sf):
    return I.with_interface(M.wire_interfaces(spark, sf)).select("contract_id", "interface")


@query("decode_value", with_views(f"SELECT event_id, {BODY} AS decoded_value FROM wired", WIRE))
def _decode_value(spark, sf):
    return M.raw(spark, sf).select("event_id", wire.decode_scval(F.col("value")).alias("decoded_value"))


@query("decode_topics", with_views(f"SELECT event_id, {TOPICS} AS decoded_topics FROM wired", WIRE))
def _decode_topics(spark, sf):
    decoded = wire.decode_topics(F.col("topics"))
    return M.raw(spark, sf).select("event_id", F.concat(F.lit("["), F.array_join(decoded, ","), F.lit("]")).alias("decoded_topics"))


@query(
    "to_event",
    with_views(
        f"SELECT event_id, contract_id, ledger, event_name, {TOPICS} AS decoded_topics, {BODY} AS decoded_value, event_id AS paging_token, "
        f"{sql_stamp('ts')} AS ledger_closed_at, false AS bad_close_time FROM wired",
        WIRE,
    ),
)
def _to_event(spark, sf):
    return to_events(M.raw(spark, sf)).select(
        "event_id", "contract_id", "ledger", "event_name",
        F.concat(F.lit("["), F.array_join("decoded_topics", ","), F.lit("]")).alias("decoded_topics"),
        "decoded_value", "paging_token", stamp("ledger_closed_at"), "bad_close_time",
    )


@query("strkey", with_views("SELECT k AS seed, txt AS key_text FROM accounts", strkey_ctes("SELECT s AS k, '30' || sha256(s) AS hx FROM (SELECT DISTINCT 'G' || o_custkey AS s FROM orders)", "accounts")))
def _strkey(spark, sf):
    seeds = M.table(spark, sf, "orders").select(F.concat(F.lit("G"), M.text("o_custkey")).alias("seed")).distinct()
    return seeds.select("seed", wire.strkey(wire.ACCOUNT_VERSION, F.unhex(F.sha2(F.col("seed").cast("binary"), 256))).alias("key_text"))


@query(
    "valid_contract",
    with_views("SELECT event_id, n % 3 = 0 AS valid FROM ev"),
)
def _valid_contract(spark, sf):
    """Good contract ids, ids with one changed character and account keys."""
    e = M.raw(spark, sf)
    n = F.col("event_id").cast("bigint") % 3
    good = F.col("contract_id")
    last = F.substring(good, F.lit(56), F.lit(1))
    changed = F.concat(F.substring(good, F.lit(1), F.lit(55)), F.when(last == "A", "B").otherwise("A"))
    account = wire.strkey(wire.ACCOUNT_VERSION, M.wire_contract_key(F.col("contract_no")))
    text = F.when(n == 0, good).when(n == 1, changed).otherwise(account)
    return e.select("event_id", wire.is_valid_contract_id(text).alias("valid"))


_NAME = "'f' || p_partkey"
_OUT = "CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'u32' ELSE 'Vec<Kind>' END"
_FORMAT = "CASE p_size % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'vec' ELSE 'map' END"
SIGNATURES = f"""SELECT 'M' || p_partkey AS contract_id, 'functions' AS section, {_NAME} AS name,
  {_NAME} || '(to: Address, amount: i128) -> ' || {_OUT} AS signature FROM part
  UNION ALL SELECT 'M' || p_partkey, 'events', 'Made' || p_partkey, 'Made' || p_partkey || '(who: Address @topic, n: u32 @data) [' || {_FORMAT} || ']' FROM part
  UNION ALL SELECT 'M' || p_partkey, 'types', 'T' || p_partkey, 'struct T' || p_partkey || ' {{ k: Kind }}' FROM part
  UNION ALL SELECT 'M' || p_partkey, 'types', 'Kind', 'enum Kind {{ Low = 0, Mid = 1, High = 2 }}' FROM part""".replace("{{", "{").replace("}}", "}")


@query("wasm_section", "SELECT 'M' || p_partkey AS contract_id, true AS found, true AS same FROM part")
def _wasm_section(spark, sf):
    found = M.part_modules(spark, sf).withColumn("section", spec_section(F.col("content")))
    return found.select(
        "contract_id", F.col("section").isNotNull().alias("found"), (F.lower(F.hex("section")) == F.lower("section_hex")).alias("same")
    )


def _parts(spark, sf):
    found = M.part_modules(spark, sf).select("contract_id", spec_section(F.col("content")).alias("section"))
    return computed_once(found, "contract_id", "section", interface=parse_interface(F.col("section")))


@query(
    "parse_interface",
    f"""SELECT 'M' || p_partkey AS contract_id, p_name AS doc, {_NAME} AS function_name, 'Made' || p_partkey AS event_name,
  lower(p_type) AS prefix, {_FORMAT} AS data_format, 'T' || p_partkey AS struct_name, 'Kind' AS field_type, 3 AS enum_cases,
  '{{"Kind":["enum",{{"0":"Low","1":"Mid","2":"High"}}],"T' || p_partkey || '":["struct",[["k",["udt","Kind"]]]]}}' AS type_defs FROM part""",
)
def _parse_interface(spark, sf):
    i = lambda path: F.col(f"interface.{path}")
    first = lambda path: F.get(i(path), F.lit(0))
    return _parts(spark, sf).select(
        "contract_id", first("functions.doc").alias("doc"), first("functions.name").alias("function_name"),
        first("events.name").alias("event_name"), F.get(first("events.prefix_topics"), F.lit(0)).alias("prefix"),
        first("events.data_format").alias("data_format"), first("structs.name").alias("struct_name"),
        F.get(first("structs.fields"), F.lit(0))["type"].alias("field_type"), F.size(first("enums.cases")).alias("enum_cases"),
        i("type_defs").alias("type_defs"),
    )


@query(
    "list_functions",
    f"""SELECT 'M' || p_partkey AS contract_id, {_NAME} AS name, p_name AS doc, 'to: Address, amount: i128' AS inputs,
  CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'u32' ELSE 'Vec<Kind>' END AS outputs FROM part""",
)
def _list_functions(spark, sf):
    shown = F.array_join(F.transform("inputs", lambda i: F.concat(i["name"], F.lit(": "), i["type"])), ", ")
    return I.functions(_parts(spark, sf)).select(
        "contract_id", "name", "doc", shown.alias("inputs"), F.array_join("outputs", ", ").alias("outputs")
    )


@query("signatures", SIGNATURES)
def _signatures(spark, sf):
    return I.interface_signatures(_parts(spark, sf))


@query("enrich", with_views(f"SELECT event_id, {ENRICHED} AS enriched FROM wired", WIRE))
def _enrich(spark, sf):
    return to_events(M.raw(spark, sf), _interfaces(spark, sf)).select("event_id", "enriched")


@query(
    "typed_events",
    with_views(
        f"""SELECT event_id, ledger, json_extract_string(e, '$.params.from.value') AS sender, json_extract_string(e, '$.params.to.value') AS receiver,
  CAST(json_extract_string(e, '$.params.amount.value') AS BIGINT) AS amount, json_extract_string(e, '$.params.status.value') AS status
  FROM (SELECT *, {ENRICHED} AS e FROM wired) WHERE no = 5 AND event_name = 'transfer'""",
        WIRE,
    ),
)
def _typed_events(spark, sf):
    """One contract's transfers with a column per declared parameter."""
    interfaces = _interfaces(spark, sf)
    contract = M.raw(spark, sf).where("contract_no = 5").select("contract_id").first()[0]
    interface = interfaces.where(F.col("contract_id") == contract).first()["interface"]
    found = typed_events(to_events(M.raw(spark, sf), interfaces), contract, interface, "Transfer")
    p = F.col("params")
    return found.select("event_id", "ledger", p["from"].alias("sender"), p["to"].alias("receiver"), p["amount"].cast("bigint").alias("amount"), p["status"].alias("status"))


def _stale(spark, sf):
    """Decoded events of which every third kept its record."""
    events = to_events(M.raw(spark, sf), _interfaces(spark, sf)).drop("bad_close_time")
    return events.withColumn("enriched", F.when(F.col("event_id").cast("bigint") % 3 == 0, F.col("enriched")))


@query("reenrich", with_views(f"SELECT event_id, {ENRICHED} AS enriched FROM wired", WIRE))
def _reenrich(spark, sf):
    return reenrich(_stale(spark, sf), _interfaces(spark, sf))[0].select("event_id", "enriched")


@query(
    "reenrich_stats",
    with_views(
        "SELECT count(*) AS processed, count(*) FILTER (WHERE event_name IN ('transfer', 'mint')) AS updated FROM wired "
        "WHERE event_name IS NOT NULL AND NOT (n % 3 = 0 AND event_name IN ('transfer', 'mint'))",
        WIRE,
    ),
)
def _reenrich_stats(spark, sf):
    table, stats = reenrich(_stale(spark, sf), _interfaces(spark, sf))
    return counted(table, stats, "processed", "updated")


TYPE_DEFS = (
    '{"Action":["union",{"Bid":[["udt","Status"]],"Cancel":[]}],"Status":["enum",{"0":"Active","7":"Filled"}],'
    '"Order":["struct",[["side",["udt","Action"]],["state",["udt","Status"]]]]}'
)


@query(
    "relabel",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE p_size % 8 WHEN 0 THEN '"Active"' WHEN 7 THEN '"Filled"' ELSE CAST(p_size % 8 AS VARCHAR) END
  WHEN 1 THEN '"Cancel"' WHEN 2 THEN '{"Bid":["Filled"]}' WHEN 3 THEN '["Bid",7,' || p_size || ']'
  WHEN 4 THEN '["Active","Filled",' || (p_size + 8) || ']' ELSE '{"extra":' || p_size || ',"side":"Cancel","state":"Filled"}' END AS named FROM part""",
)
def _relabel(spark, sf):
    p = M.table(spark, sf, "part")
    kind, size = F.col("p_partkey") % 6, M.text("p_size")
    status, action = '["udt","Status"]', '["udt","Action"]'
    value = (
        F.when(kind == 0, M.text(F.col("p_size") % 8))
        .when(kind == 1, '["Cancel"]')
        .when(kind == 2, '["Bid",7]')
        .when(kind == 3, F.concat(F.lit('["Bid",7,'), size, F.lit("]")))
        .when(kind == 4, F.concat(F.lit("[0,7,"), M.text(F.col("p_size") + 8), F.lit("]")))
        .otherwise(F.concat(F.lit('{"extra":'), size, F.lit(',"side":["Cancel"],"state":7}')))
    )
    shape = F.when(kind == 0, status).when(kind.isin(1, 2, 3), action).when(kind == 4, f'["vec",{status}]').otherwise('["udt","Order"]')
    named = relabel(F.array(value), F.array(shape), F.lit(TYPE_DEFS))
    return p.select("p_partkey", F.get(named, F.lit(0)).alias("named"))


@query(
    "storage_key",
    with_views(
        """SELECT s AS holder, to_base64(unhex(body)) AS key_xdr, sha256(to_base64(unhex(body))) AS key_hash, '["Balance","' || txt || '"]' AS key_json
  FROM (SELECT k AS s, txt, '000000100000000100000002' || '0000000F00000007' || hex(encode('Balance')) || '00' || '00000012' || repeat('0', 16) || upper(sha256(k)) AS body FROM accounts)""",
        strkey_ctes("SELECT s AS k, '30' || sha256(s) AS hx FROM (SELECT DISTINCT 'G' || user_id AS s FROM events)", "accounts"),
    ),
)
def _storage_key(spark, sf):
    seeds = M.table(spark, sf, "events").select(F.concat(F.lit("G"), M.text("user_id")).alias("holder")).distinct()
    text = wire.strkey(wire.ACCOUNT_VERSION, F.unhex(F.sha2(F.col("holder").cast("binary"), 256)))
    keyed = seeds.withColumn("address", text).withColumn("k", wire.storage_key(F.lit("Balance"), F.array("address")))
    return keyed.select("holder", "k.key_xdr", "k.key_hash", "k.key_json")


def _decoded(spark, sf):
    return to_events(M.raw(spark, sf))


@query(
    "holders",
    with_views(
        "SELECT DISTINCT contract_id, t AS holder FROM (SELECT contract_id, unnest([t1, t2]) AS t FROM wired WHERE event_name IS NOT NULL)", WIRE
    ),
)
def _holders(spark, sf):
    return discovery.holders(_decoded(spark, sf))


def templates(spark):
    return spark.createDataFrame(
        [
            ("Balance", ["transfer", "mint", "mint"], [1], None, "balance"),
            ("Allowance", ["transfer"], [1, 2], "temporary", None),
            ("Missing", ["burn"], [1, 5], None, None),
            ("Named", ["burn"], [0], None, None),
        ],
        "symbol string, events array<string>, params array<int>, durability string, label string",
    )


@query(
    "template_keys",
    with_views(
        """SELECT DISTINCT contract_id, 'Balance' AS symbol, 'persistent' AS durability, 'balance' AS label, t1 AS addresses FROM wired WHERE event_name IN ('transfer', 'mint')
  UNION ALL SELECT DISTINCT contract_id, 'Allowance', 'temporary', NULL, t1 || ',' || t2 FROM wired WHERE event_name = 'transfer'""",
        WIRE,
    ),
)
def _template_keys(spark, sf):
    keys = discovery.template_keys(_decoded(spark, sf), templates(spark))
    return keys.withColumn("addresses", F.array_join("addresses", ","))


@query(
    "sign_values",
    with_views(
        """SELECT event_id, sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(amount)))) AS signature FROM (SELECT event_id, amount,
  array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(kx, CAST(i * 2 + 1 AS INT), 2) AS INT), 54))), '') AS ipad,
  array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST('0x' || substr(kx, CAST(i * 2 + 1 AS INT), 2) AS INT), 92))), '') AS opad
  FROM (SELECT event_id, amount, rpad(hex(encode(topic1)), 128, '0') AS kx FROM ev))"""
    ),
)
def _sign_values(spark, sf):
    e = M.ev(spark, sf)
    secret = F.btrim(F.get("decoded_topics", F.lit(1)), F.lit('"'))
    # Padded keys once per distinct secret, then two hash rounds per row.
    pads = e.select(secret.alias("secret")).distinct().select("secret", signing.hmac_pads(F.col("secret")).alias("pads"))
    from eventloom.plans.joins import lookup_join

    joined = lookup_join(e.select("event_id", secret.alias("secret"), "decoded_value"), pads, ["secret"])
    return joined.select("event_id", signing.hmac_sha256(F.col("pads"), F.btrim("decoded_value", F.lit('"'))).alias("signature"))
