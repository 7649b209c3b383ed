import json

from conftest import rows
from pyspark.sql import functions as F
from wirebuild import TRANSFER_MODULE, b64, i128, symbol

from eventloom.operators.convert import to_events
from eventloom.operators.interfaces import with_interface
from eventloom.sources import archive, entries, modules, pages, store
from eventloom.sources.watchlist import watchlist, watchlist_total


def flat(**over):
    base = {"id": "e7", "contract_id": "KA", "ledger": 77, "ledger_closed_at": "2024-01-01T00:00:00Z", "type": "contract", "topic": [], "value": "", "tx_hash": "t77"}
    return json.dumps({k: v for k, v in {**base, **over}.items() if v != "drop"})


def envelope(*events, **over):
    return json.dumps({"ledger": 100, "ledger_close_time": "2024-01-01T00:00:00Z", "events": list(events), **over})


def parse(spark, *lines, **kwargs):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return archive.parse_archive(df, **{"from_ledger": 0, **kwargs})


def test_archive_shapes(spark):
    ev, bad = parse(spark, flat(), envelope({"id": "a", "contract_id": "KA"}, {"event_id": "b", "id": "x", "contract_id": "CB"}), "", "   ", "# note", "  #x")
    assert rows(ev, "event_id", "contract_id", "ledger", "paging_token", "in_successful_call", "event_type") == [
        ("a", "KA", 100, "a", True, "contract"), ("b", "CB", 100, "b", True, "contract"), ("e7", "KA", 77, "e7", True, "contract"),
    ]
    assert bad.count() == 0


def test_archive_defaults_and_drops(spark):
    ev, bad = parse(
        spark,
        envelope({"contract_id": "KA"}, {"id": "n", "contract_id": None}, {"id": None, "event_id": "k", "contract_id": "KA", "paging_token": "p"}),
        envelope(events=None), flat(paging_token="", in_successful_contract_call=False, type=None, topic="drop", value="drop", tx_hash="drop"),
    )
    got = rows(ev, "event_id", "paging_token", "in_successful_call", "event_type", "tx_hash")
    assert got == [("e7", "e7", False, "contract", ""), ("k", "p", True, "contract", "")]
    assert bad.count() == 0


def test_archive_rejects(spark):
    lines = [
        "{not valid json}", "[1]", "5", flat(contract_id="drop"), flat(id="drop"), flat(ledger="drop"), flat(ledger="7"), flat(ledger=1.5),
        flat(topic=["a", 1]), flat(topic=None), flat(topic=[None]), flat(value=5), flat(value=None), flat(in_successful_contract_call="yes"), flat(ledger_closed_at=5),
        envelope({"id": "a", "contract_id": "C", "topic": "x"}), envelope({"id": 5, "contract_id": "C"}), envelope("text"), envelope(events={}),
        envelope(ledger=None), json.dumps({"events": []}), envelope(ledger_close_time=3),
    ]
    ev, bad = parse(spark, *lines)
    assert ev.count() == 0
    assert sorted(r["line"] for r in bad.collect()) == sorted(lines)


def test_archive_ranges_and_files(spark, folder):
    import gzip

    with gzip.open(f"{folder}/a.ndjson.gz", "wt") as f:
        f.write("\n".join(flat(id=f"e{i}", ledger=i, contract_id=f"C{i % 2}") for i in range(10)))
    with open(f"{folder}/b.ndjson", "w") as f:
        f.write(flat(id="z", ledger=5, contract_id="C1") + "\nbroken\n")
    ev, bad = archive.read_archive(spark, folder, 3, 7, ["C1"])
    assert [r[0] for r in rows(ev, "event_id")] == ["e3", "e5", "e7", "z"]
    assert bad.count() == 1


PAGE1 = {
    "latestLedger": 600, "cursor": "p2",
    "events": [
        {"type": "contract", "ledger": 500, "ledgerClosedAt": "2024-01-01T00:00:00Z", "contractId": "C1", "id": i, "pagingToken": i,
         "inSuccessfulContractCall": True, "txHash": "tx1", "topic": [b64(symbol("mint"))], "value": b64(i128(5))}
        for i in ("e7", "e2")
    ],
}
PAGE2 = {"latestLedger": 600, "events": [{"type": "contract", "ledger": 501, "ledgerClosedAt": "bad time", "contractId": "C2", "id": "e3"}]}


def test_pages(spark, folder):
    for i, page in enumerate((PAGE1, PAGE2)):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write(json.dumps(page) + "\n")
    ev = pages.read_pages(spark, folder)
    assert rows(ev, "event_id", "paging_token", "in_successful_call", "tx_hash", "value")[1] == ("e3", "e3", False, "", "")
    assert ev.count() == 3 and pages.read_pages(spark, folder, ["C2"]).count() == 1
    done = to_events(ev)
    assert rows(done, "event_id", "event_name", "decoded_value", "bad_close_time") == [
        ("e2", "mint", '"5"', False), ("e3", None, '{"_xdr":""}', True), ("e7", "mint", '"5"', False),
    ]


def test_pages_over_several_lines_and_bad_ones(spark, folder):
    with open(f"{folder}/pretty.json", "w") as f:
        f.write(json.dumps(PAGE1, indent=2))
    assert pages.read_pages(spark, folder, whole_files=True).count() == 2
    bad = ["{", json.dumps({"events": []}), json.dumps({"latestLedger": 1}), json.dumps({"latestLedger": 1, "events": [{"id": "x"}]}),
           json.dumps({"latestLedger": "x", "events": []})]
    lines = spark.createDataFrame([(x,) for x in [*bad, json.dumps(PAGE1)]], "value string")
    assert sorted(r[0] for r in pages.page_rejects(lines).collect()) == sorted(bad)
    assert pages.parse_pages(lines).count() == 2


def test_close_times(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01t00:00:00.5z", "2024-01-01", "", "now", None]
    raw = spark.createDataFrame([(str(i), "C", 1, t, "contract", [], "", "", True, "") for i, t in enumerate(texts)],
                                "event_id string, contract_id string, ledger long, ledger_closed_at string, event_type string, topics array<string>, value string, tx_hash string, in_successful_call boolean, paging_token string")
    got = rows(to_events(raw).select("event_id", F.unix_millis("ledger_closed_at").alias("ms"), "bad_close_time", "paging_token"))
    base = 1_704_067_200_000
    assert [(r[1], r[2]) for r in got] == [(base, False), (base, False), (base + 500, False)] + [(None, True)] * 4
    assert got[0][3] == "0"


def test_modules(spark, folder):
    import hashlib

    for i in range(2):
        with open(f"{folder}/{i}.wasm", "wb") as f:
            f.write(TRANSFER_MODULE)
    with open(f"{folder}/plain.wasm", "wb") as f:
        f.write(b"\0asm\1\0\0\0")
    hashes = [hashlib.sha256(m).hexdigest() for m in (TRANSFER_MODULE, b"\0asm\1\0\0\0")]
    owners = spark.createDataFrame([("A", hashes[0]), ("B", hashes[0]), ("P", hashes[1]), ("X", "none")], "contract_id string, wasm_hash string")
    found = modules.read_modules(spark, folder, owners)
    assert rows(found.select("contract_id", F.col("section").isNull().alias("n"))) == [("A", False), ("B", False), ("P", True)]
    assert rows(with_interface(found), "contract_id") == [("A",), ("B",)]


def test_entries(spark, folder):
    lines = [
        {"contract_id": "C", "wasm_hash": "h", "storage": b64(i128(5)), "last_modified_ledger": 9},
        {"contract_id": "C", "key": b64(symbol("k")), "durability": " Temporary", "val": b64(symbol("v")), "last_modified_ledger": 10},
        {"contract_id": "C", "key": b64(symbol("k")), "val": b64(symbol("v")), "last_modified_ledger": 11},
        {"contract_id": "C"},
    ]
    with open(f"{folder}/e.json", "w") as f:
        f.write("\n".join(map(json.dumps, lines)))
    found = entries.read_entries(spark, folder)
    assert rows(entries.instance_observations(found)) == [("C", "h", 9, '"5"')]
    assert rows(entries.data_observations(found, "l"), "key", "durability", "ledger", "value", "label") == [
        ('"k"', "persistent", 11, '"v"', "l"), ('"k"', "temporary", 10, '"v"', "l"),
    ]


def test_watchlist(spark):
    df = spark.createDataFrame([("C1", 5, "1"), ("C2", None, "2"), ("C3", 7, "3"), ("C1", 99, "4"), (None, 1, "5"), ("C4", 1, "6")],
                               "contract string, events long, paging_token string")
    assert [tuple(r) for r in watchlist(df).collect()] == [("C4", 1), ("C3", 7), ("C1", 5)]
    assert [r[0] for r in watchlist(df, "asc", 2, active_only=False).collect()] == ["C1", "C2"]
    assert watchlist_total(watchlist(df)).first()[0] == 13


def test_store_prunes_folders(spark, folder):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("event_id"), F.concat(F.lit("C"), F.col("id") % 3).alias("contract_id"), (F.col("id") * 100).alias("ledger")
    )
    store.write_events(df, f"{folder}/ev")
    kept = store.read_events(spark, f"{folder}/ev", 20_000, 30_000)
    assert rows(kept) == rows(df.where("ledger between 20000 and 30000"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ledger_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
