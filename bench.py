"""Headline timings: one JSON line.

Queries run over $BENCH_SF_DIR on local[$BENCH_CPUS]. Each is run once to warm
up and then timed; the whole result is produced (noop sink), never sampled.
``ingest`` is the reference workload: undecoded events are read from files,
decoded, enriched, de-duplicated, stored and projected; its rate is reported
as events per second. ``ingest_tail`` is the last of several smaller batches
into the store that the first one filled, with re-read ledgers compared.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from eventloom.operators import interfaces  # noqa: E402
from eventloom.plans import catalog, mapping  # noqa: E402
from eventloom.session import build_session, shared_dir  # noqa: E402
from eventloom.streaming import ingest  # noqa: E402

HEADLINES = [
    "q_contracts", "agg_summaries", "stats_hour_named", "stats_ledger", "q_events", "q_page_keyset", "q_tx", "q_data_latest",
    "proj_transfers", "proj_swaps", "proj_nfts", "proj_liquidity", "match_events", "enqueue", "due_payloads", "apply_outcomes",
    "auto_disable", "version_history", "diff_versions", "retain_data", "seam_union", "sink_insert_new", "sink_upsert_reorg",
    "decode_value", "decode_topics", "enrich", "holders", "template_keys", "src_archive", "agg_route_latency", "series_rate", "alerts",
]

TAIL_BATCHES = 8


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__local__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    only = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINES
    seconds = {}
    for name in only:
        run = catalog.QUERIES[name]
        drain(run(spark, sf_dir))
        seconds[name] = timed(lambda: drain(run(spark, sf_dir)))

    # Undecoded events on disk, outside the timing.
    base = shared_dir(spark, "bench")
    mapping.raw(spark, sf_dir).repartition(int(cpus)).write.parquet(f"{base}/raw")
    known = interfaces.with_interface(mapping.wire_interfaces(spark, sf_dir)).select("contract_id", "interface")
    raw = spark.read.parquet(f"{base}/raw")
    ingest.ingest_batch(raw.where(F.lit(True)), 0, f"{base}/warm", known)
    seconds["ingest"] = timed(lambda: ingest.ingest_batch(raw, 0, f"{base}/out", known))
    events = ingest.committed_events(spark, f"{base}/out").count()
    # Further batches of new events over the store that is there by now; the last one counts.
    step = raw.where(F.crc32(F.encode("event_id", "UTF-8")) % 10 == 0)
    step_events = step.count()
    for k in range(1, TAIL_BATCHES + 1):
        more = step.withColumn("event_id", F.concat(F.lit(f"b{k}-"), F.col("event_id"))).withColumn("ledger", F.col("ledger") + 10 * k)
        seconds["ingest_tail"] = timed(lambda: ingest.ingest_batch(more, k, f"{base}/out", known, reorg_ledgers=1000))
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(s for name, s in seconds.items() if name != "ingest_tail"), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "ingest_events": events,
                "ingest_events_per_sec": round(events / seconds["ingest"], 1),
                "ingest_tail_events": step_events, "ingest_tail_events_per_sec": round(step_events / seconds["ingest_tail"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
