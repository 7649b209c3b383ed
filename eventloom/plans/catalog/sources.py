"""Sources and the storage layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.wire import decode_scval, decode_topics
from eventloom.operators.interfaces import with_interface
from eventloom.plans import mapping as M
from eventloom.plans.catalog import query
from eventloom.plans.catalog.decoding import BODY, TOPICS, WIRE
from eventloom.plans.oracle import stamp, with_views
from eventloom.session import shared_dir
from eventloom.sources import archive, entries, history, modules, pages, store
from eventloom.sources.watchlist import watchlist, watchlist_total

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_BASE = "SELECT event_id AS n, 'C' || (user_id % 10) AS contract_id, CAST(floor(epoch(ts) / 5) AS BIGINT) AS ledger, ts FROM events"
# Which lines of the derived archive are flat records and which envelopes.
FLAT, ENVELOPE = "n % 10 IN (0, 6, 8)", "n % 10 IN (5, 7, 9)"
ARCHIVE = f"""
  SELECT 'e' || n AS event_id, contract_id, ledger, {_ISO} AS ledger_closed_at, 'contract' AS event_type, 'AAAADwAAAANmZWUA' AS topics,
    '' AS value, 't' AS tx_hash, true AS in_successful_call, 'p' || n AS paging_token FROM b WHERE {FLAT}
  UNION ALL SELECT 'e' || n, contract_id, ledger, {_ISO}, 'contract', '', '', '', false, 'e' || n FROM b WHERE {ENVELOPE}
  UNION ALL SELECT 'x' || n, contract_id, ledger, {_ISO}, 'system', '', '', '', true, 'x' || n FROM b WHERE {ENVELOPE}"""


def _archive(spark, sf, **kwargs):
    return archive.parse_archive(M.archive_lines(spark, sf), **{"from_ledger": 0, **kwargs})


@query("src_archive", f"WITH b AS ({_BASE}) {ARCHIVE}")
def _src_archive(spark, sf):
    return _archive(spark, sf)[0].withColumn("topics", F.array_join("topics", ","))


@query("src_archive_file", f"WITH b AS ({_BASE}) {ARCHIVE}")
def _src_archive_file(spark, sf):
    """The same lines, some behind tabs, in compressed files, with blank and comment lines behind tabs."""
    path = shared_dir(spark, "archive")
    tab = F.when(F.crc32(F.encode("value", "UTF-8")) % 2 == 0, F.lit("\t")).otherwise(F.lit(""))
    lines = M.archive_lines(spark, sf).select(F.concat(tab, F.col("value")).alias("value"))
    noise = spark.sql("SELECT explode(array('\\t# note', '\\t \\t', ' \\t#')) AS value")
    lines.unionByName(noise).write.option("compression", "gzip").text(path)
    return archive.read_archive(spark, path, 0, spread=8)[0].withColumn("topics", F.array_join("topics", ","))


@query(
    "src_archive_range",
    f"WITH b AS ({_BASE}) SELECT * FROM ({ARCHIVE}) WHERE ledger BETWEEN 340900000 AND 341200000 AND contract_id IN ('C3', 'C7')",
)
def _src_archive_range(spark, sf):
    found = _archive(spark, sf, from_ledger=340_900_000, to_ledger=341_200_000, contract_ids=["C3", "C7"])[0]
    return found.withColumn("topics", F.array_join("topics", ","))


@query(
    "src_archive_rejects",
    f"""WITH b AS ({_BASE}) SELECT CASE n % 10 WHEN 1 THEN 'invalid JSON' WHEN 3 THEN 'contract_id missing' ELSE 'ledger missing or not an integer' END AS reason,
  count(*) AS lines FROM b WHERE n % 10 IN (1, 3, 4) GROUP BY 1""",
)
def _src_archive_rejects(spark, sf):
    return _archive(spark, sf)[1].groupBy("reason").agg(F.count("*").alias("lines"))


@query(
    "src_archive_loaded",
    f"""WITH b AS ({_BASE}) SELECT event_id, contract_id, ledger, tx_hash, NULL AS reason FROM ({ARCHIVE}) UNION ALL
  SELECT NULL, NULL, NULL, CAST(count(*) AS VARCHAR), CASE n % 10 WHEN 1 THEN 'invalid JSON' WHEN 3 THEN 'contract_id missing' ELSE 'ledger missing or not an integer' END AS reason
  FROM b WHERE n % 10 IN (1, 3, 4) GROUP BY reason""",
)
def _src_archive_loaded(spark, sf):
    """Events and rejects of one parse."""
    events, rejects = archive.load_archive(M.archive_lines(spark, sf), shared_dir(spark, "archive"))
    counted = rejects.groupBy("reason").agg(F.count("*").cast("string").alias("tx_hash"))
    return events.select("event_id", "contract_id", "ledger", "tx_hash").unionByName(counted, allowMissingColumns=True)


def _history(spark, sf):
    path = shared_dir(spark, "history")
    history.write_history(M.history_lines(spark, sf), path)
    return path


@query("src_history", f"WITH b AS ({_BASE}) SELECT * FROM ({ARCHIVE}) WHERE ledger BETWEEN 340900000 AND 341200000")
def _src_history(spark, sf):
    """A ledger range of a foldered history, through the pluggable source."""
    found = history.read_history(spark, _history(spark, sf), 340_900_000, 341_200_000)[0]
    return found.withColumn("topics", F.array_join("topics", ","))


@query("src_history_contract", f"WITH b AS ({_BASE}) SELECT * FROM ({ARCHIVE}) WHERE contract_id = 'C3'")
def _src_history_contract(spark, sf):
    found = history.read_history(spark, _history(spark, sf), contract_ids=["C3"])[0]
    return found.withColumn("topics", F.array_join("topics", ","))


@query("st_history", f"WITH b AS ({_BASE}) {ARCHIVE}")
def _st_history(spark, sf):
    """The same history followed as a stream, its ranges up to the last but one first."""
    path = _history(spark, sf)
    for final in (False, True):
        raw = history.follow_history(spark, path, final=final).withColumn("topics", F.array_join("topics", ","))
        kept = raw.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-checkpoint")
        kept.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}-out")


@query(
    "src_pages",
    with_views(
        f"SELECT event_id, contract_id, ledger, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ledger_closed_at, 'contract' AS event_type, 3 AS topics, "
        "'tx' || (n // 3) AS tx_hash, event_name IS DISTINCT FROM 'clawback' AS in_successful_call, event_id AS paging_token FROM wired",
        WIRE,
    ),
)
def _src_pages(spark, sf):
    found = pages.parse_pages(M.page_lines_from(M.table(spark, sf, "events")))
    return found.withColumn("topics", F.size("topics")).drop("value")


@query("src_pages_file", with_views(f"SELECT event_id, contract_id, ledger, 'tx' || (n // 3) AS tx_hash, {BODY} AS decoded_value, {TOPICS} AS decoded_topics FROM wired", WIRE))
def _src_pages_file(spark, sf):
    """Pages from files; bodies of all three kinds are decoded and compared."""
    path = shared_dir(spark, "pages")
    M.page_lines_from(M.table(spark, sf, "events")).write.text(path)
    topics = F.concat(F.lit("["), F.array_join(decode_topics(F.col("topics")), ","), F.lit("]"))
    found = pages.read_pages(spark, path)
    return found.select("event_id", "contract_id", "ledger", "tx_hash", decode_scval(F.col("value")).alias("decoded_value"), topics.alias("decoded_topics"))


_ENTRIES = """SELECT contract_id, kind, ledger, value, key, durability FROM (SELECT 'C' || (user_id % 10) AS contract_id, CAST(floor(epoch(ts) / 5) AS BIGINT) AS ledger,
  '"' || CAST(round(value * 100) AS BIGINT) || '"' AS value, CASE WHEN event_id % 2 = 0 THEN 'instance' ELSE 'data' END AS kind,
  CASE WHEN event_id % 2 = 1 THEN '"key' || user_id || '"' END AS key, CASE WHEN event_id % 2 = 1 THEN 'temporary' END AS durability FROM events)"""


def _observed_entries(rows):
    none = F.lit(None).cast("string")
    instances = entries.instance_observations(rows).select(
        "contract_id", F.lit("instance").alias("kind"), "ledger", F.col("storage").alias("value"), none.alias("key"), none.alias("durability")
    )
    data = entries.data_observations(rows).select("contract_id", F.lit("data").alias("kind"), "ledger", "value", "key", "durability")
    return instances.unionByName(data)


@query("src_entries", _ENTRIES)
def _src_entries(spark, sf):
    return _observed_entries(entries.parse_entries(M.entry_lines(spark, sf)))


@query("src_entries_file", _ENTRIES)
def _src_entries_file(spark, sf):
    path = shared_dir(spark, "entries")
    M.entry_lines(spark, sf).write.text(path)
    return _observed_entries(entries.read_entries(spark, path))


@query("src_wasm", "SELECT 'M' || p_partkey AS contract_id, 'f' || p_partkey AS function_name FROM part")
def _src_wasm(spark, sf):
    files = M.part_modules(spark, sf)
    owners = files.select("contract_id", F.sha2("content", 256).alias("wasm_hash"))
    found = with_interface(modules.attach_modules(files.select("content"), owners))
    return found.select("contract_id", F.get("interface.functions.name", F.lit(0)).alias("function_name"))


def _directory(spark, sf):
    o = M.table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("C"), M.padded("o_custkey", 6)).alias("contract"), (F.col("o_orderkey") % 5).alias("events"),
        M.padded("o_orderkey", 12).alias("paging_token"),
    )


_WATCH = """WITH f AS (SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS contract, arg_min(o_orderkey % 5, o_orderkey) AS events FROM orders GROUP BY 1),
  w AS (SELECT contract, events FROM f WHERE events > 0 ORDER BY contract DESC LIMIT 200) """


@query("src_watchlist", _WATCH + "SELECT * FROM w")
def _src_watchlist(spark, sf):
    return watchlist(_directory(spark, sf), limit=200)


@query("src_watchlist_total", _WATCH + "SELECT CAST(sum(events) AS BIGINT) AS events FROM w")
def _src_watchlist_total(spark, sf):
    return watchlist_total(watchlist(_directory(spark, sf), limit=200))


@query(
    "sink_parts",
    with_views(f"SELECT event_id, contract_id, ledger, event_name, {stamp('ledger_closed_at')} AS ledger_closed_at FROM ev WHERE ledger BETWEEN 340900000 AND 341200000"),
)
def _sink_parts(spark, sf):
    from eventloom.plans.catalog import stamped

    path = shared_dir(spark, "events")
    store.write_events(M.ev(spark, sf), path)
    kept = store.read_events(spark, path, 340_900_000, 341_200_000)
    return stamped(kept.select("event_id", "contract_id", "ledger", "event_name", "ledger_closed_at"), "ledger_closed_at")
