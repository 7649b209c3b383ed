"""Projections, reads, series, retention and merges on small literal tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventloom.functions import wire
from eventloom.operators import aggregates as A
from eventloom.operators import discovery, merge, reads, series, verticals


def ev(spark, *given):
    """given: (id, contract, ledger, name, topics, body)."""
    df = spark.createDataFrame(list(given), "event_id string, contract_id string, ledger long, event_name string, decoded_topics array<string>, decoded_value string")
    return df.withColumn("ledger_closed_at", F.timestamp_seconds(F.col("ledger") * 5))


def one(spark, name, topics, body):
    return ev(spark, ("e1", "C1", 42, name, topics, body))


def test_transfers(spark):
    def got(name, topics, body):
        r = verticals.token_transfers(one(spark, name, topics, body)).first()
        return r and (r["kind"], r["from_addr"], r["to_addr"], r["amount"])

    assert got("transfer", ['"transfer"', '"GFROM"', '"GTO"'], '"300"') == ("transfer", "GFROM", "GTO", "300")
    assert got("mint", ['"mint"', '"GR"'], '"1000"') == ("mint", None, "GR", "1000")
    assert got("burn", ['"burn"', '"GB"'], '"500"') == ("burn", "GB", None, "500")
    assert got("clawback", ['"clawback"', '"GV"'], '"750"') == ("clawback", "GV", None, "750")
    assert got("approval", ['"approval"'], '"1"') is None
    assert got("transfer", ['"transfer"', '"A"', '"B"'], "300")[3] == "300"
    assert got("transfer", ['"transfer"'], '"5"') == ("transfer", None, None, "5")
    assert got("transfer", ['"transfer"', "5", '{"a":1}'], '{"x":1}') == ("transfer", None, None, '{"x":1}')


def test_swaps(spark):
    src = ev(
        spark,
        ("1", "C", 1, "swap", ['"swap"', '"A"', '"B"', '"U"'], '{"buy_amount":"2","sell_amount":"1"}'),
        ("2", "C", 1, "swap", ['"swap"', '"A"', '"B"'], '{"sell_amount":"1"}'),
        ("3", "C", 1, "trade", ['"trade"', '"A"', '"B"'], '{"in":"1","out":7}'),
        ("4", "C", 1, "other", [], "null"),
    )
    assert rows(verticals.amm_swaps(src), "event_id", "sender", "sell_amount", "buy_amount") == [("1", "U", "1", "2")]
    both = verticals.amm_swaps(src, fields={"trade": ("in", "out")})
    assert rows(both, "event_id", "sender", "sell_token", "buy_token", "sell_amount", "buy_amount", "raw_event_name")[1] == ("3", None, "A", "B", "1", "7", "trade")


def test_nfts_and_fungible_lookalikes(spark):
    g = wire.encode_strkey(0x30, bytes(32))
    src = ev(
        spark,
        ("1", "C", 1, "mint", ['"mint"', '"T"', "7"], "null"), ("2", "C", 1, "transfer", ['"transfer"', '"F"', '"T"', '{"k":1}'], "null"),
        ("3", "C", 1, "burn", ['"burn"', '"F"', '"id"'], '{"a":1}'),
        ("4", "C", 1, "transfer", ['"transfer"', '"F"', '"T"', '"native"'], '"5"'), ("5", "C", 1, "transfer", ['"transfer"', '"F"', '"T"', f'"USD:{g}"'], "null"),
        ("6", "C", 1, "mint", ['"mint"', '"admin"', f'"{g}"'], "null"), ("7", "C", 1, "mint", ['"mint"', '"T"', "7"], '"100"'),
        ("8", "C", 1, "transfer", ['"transfer"', '"F"', '"T"'], "null"), ("9", "N", 1, "mint", ['"mint"', '"T"', "7"], '"100"'),
    )
    assert rows(verticals.nft_events(src), "event_id", "from_addr", "to_addr", "token_id") == [
        ("1", None, "T", "7"), ("2", "F", "T", '{"k":1}'), ("3", "F", None, "id"),
    ]
    known = spark.createDataFrame([("N",)], "contract_id string")
    for given in (["N"], known):
        assert [r[0] for r in rows(verticals.nft_events(src, given), "event_id")] == ["1", "2", "3", "9"]


def test_liquidity(spark):
    src = ev(
        spark,
        ("1", "C", 1, "deposit", ['"deposit"', '"P"'], '{"amounts":["1","2"],"shares_minted":"9"}'),
        ("2", "C", 1, "remove_liquidity", ['"x"', '"P"'], '{"amounts":["1","2","3",4],"shares_burned":"9"}'),
        ("3", "C", 1, "withdraw", ['"x"'], '{"amounts":["1"]}'), ("4", "C", 1, "add_liquidity", ['"x"', '"P"'], "null"), ("5", "C", 1, "swap", [], "null"),
    )
    assert rows(verticals.liquidity_events(src), "event_id", "event_kind", "provider", "amount_a", "amount_b", "shares", "extra_amounts") == [
        ("1", "add", "P", "1", "2", "9", None), ("2", "remove", "P", "1", "2", "9", '["3",4]'),
        ("3", "remove", None, "1", None, None, None), ("4", "add", "P", None, None, None, None),
    ]


def test_paging_covers_everything_once(spark):
    df = spark.range(25).select((F.col("id") % 4).alias("ledger"), F.format_string("e%02d", "id").alias("event_id"))
    seen, after = [], None
    while True:
        got, after = reads.page(df, limit=7, after=after)
        seen += [(r["ledger"], r["event_id"]) for r in got]
        if after is None:
            break
    assert seen == sorted((tuple(r) for r in df.collect()), reverse=True)
    lazy = reads.page_rows(df, limit=7)
    assert [(r["ledger"], r["event_id"]) for r in lazy.collect()] == seen[:7]
    assert {r["has_next"] for r in lazy.collect()} == {True}
    assert reads.page_rows(df, limit=100).select("has_next").distinct().first()[0] is False
    assert [r["event_id"] for r in reads.page_offset(df, 5, -3).collect()] == [i for _, i in seen[:5]]
    assert len(reads.page(df, limit=0)[0]) == 1


def test_filters_reject_bad_input(spark):
    src = one(spark, "x", ['"x"'], "1")
    with pytest.raises(ValueError):
        reads.list_events(src, "C1", from_ledger=5, to_ledger=4)
    with pytest.raises(ValueError):
        reads.list_nfts(src, "C1", kind="swap")
    with pytest.raises(ValueError):
        reads.list_liquidity(src, "C1", kind="mint")
    with pytest.raises(ValueError):
        A.contract_stats(src, "C1", "week")
    with pytest.raises(ValueError):
        A.contract_stats(src, "C1", "day", group_by="contract")
    assert reads.list_events(src, "C1", topics={0: "x"}).count() == 1
    assert reads.list_events(src, "C1", topics={1: "x"}).count() == 0


def test_stats_breakdown_ignores_unnamed(spark):
    src = ev(spark, ("1", "C", 17280 * 2, "a", [], ""), ("2", "C", 17280 * 2, None, [], ""), ("3", "C", 17280, None, [], ""))
    got = [tuple(r) for r in A.contract_stats(src, "C", "day", group_by="event_name").collect()]
    assert got == [("1970-01-03 00:00:00+00", 2, {"a": 1}), ("1970-01-02 00:00:00+00", 1, None)]


def test_retention(spark):
    src = ev(spark, *[(str(n), "C", n, "x", [], "") for n in (499, 500, 501)])
    assert [r[0] for r in rows(series.prune_events(src, 1000, 500), "ledger")] == [500, 501]
    assert series.prune_events(src, 1000, 0).count() == 3 and series.prune_events(src, 400, 500).count() == 3
    st = spark.createDataFrame([("C1", 10, "a"), ("C1", 20, "b"), ("C2", 5, "c"), ("C2", 600, "d"), ("C3", 500, "e")], "contract_id string, ledger long, storage string")
    assert rows(series.prune_state(st, 1000, 500), "contract_id", "ledger") == [("C1", 20), ("C2", 600), ("C3", 500)]
    cd = spark.createDataFrame([("C", "k1", 10, "a"), ("C", "k1", 20, "b"), ("C", "k2", 10, "c")], "contract_id string, key_hash string, ledger long, value string")
    assert rows(series.prune_data(cd, 1000, 500), "key_hash", "ledger") == [("k1", 20), ("k2", 10)]
    child = spark.createDataFrame([("499", 1), ("501", 2), (None, 3)], "event_id string, n int")
    assert rows(series.cascade(child, series.prune_events(src, 1000, 500)), "n") == [(2,), (3,)]


def test_snapshots(spark):
    stored = spark.createDataFrame([("C1", 10, "a"), ("C1", 20, "b")], "contract_id string, ledger long, storage string")
    seen = spark.createDataFrame([("C1", 20, "b"), ("C1", 10, "x"), ("C1", 30, "c"), ("C1", 30, "c"), ("C2", 10, "d")], "contract_id string, ledger long, storage string")
    assert rows(series.snapshot_state(stored, seen)) == [("C1", 30, "c"), ("C2", 10, "d")]


def test_upsert(spark):
    cols = "event_id string, contract_id string, decoded_topics array<string>, decoded_value string, enriched string"
    stored = spark.createDataFrame([("1", "C", ["a"], "x", None), ("2", "C", ["a"], "x", None), ("3", "C", ["a"], "x", "y")], cols)
    new = spark.createDataFrame([("1", "MOVED", ["b"], "x", "e"), ("2", "C", ["a"], "x", None), ("4", "D", ["a"], "x", None), ("4", "D", ["a"], "x", None)], cols)
    merged, stats = merge.upsert_events(stored, new)
    assert "FullOuter" in merged._jdf.queryExecution().executedPlan().toString()
    assert rows(merged) == [("1", "C", ["b"], "x", "e"), ("2", "C", ["a"], "x", None), ("3", "C", ["a"], "x", "y"), ("4", "D", ["a"], "x", None)]
    assert stats.get == {"inserted": 1, "updated": 1}  # of that run


def test_first_copy_and_seam(spark):
    a = spark.createDataFrame([("1", "arch"), ("2", "arch")], "event_id string, v string")
    b = spark.createDataFrame([("2", "live"), ("3", "live"), ("3", "later")], "event_id string, v string")
    assert rows(merge.seam(a, b)) == [("1", "arch"), ("2", "arch"), ("3", "later")]
    ordered = b.withColumn("n", F.when(F.col("v") == "live", 0).otherwise(1))
    assert rows(merge.insert_new(a, ordered, F.col("n")), "event_id", "v") == [("3", "live")]


def keys(seed):
    return wire.encode_strkey(0x30, bytes([seed]) * 32)


def test_holders(spark):
    g, c = keys(1), wire.encode_strkey(0x10, bytes([2]) * 32)
    src = ev(
        spark, ("1", "C", 1, "transfer", ['"transfer"', f'"{g}"', f'"{c}"'], "null"), ("2", "C", 1, "set_admin", [f'"{keys(3)}"'], "null"),
        ("3", "C", 1, "mint", ['"mint"', '"100"'], "null"), ("4", "C", 2, "burn", ['"burn"', f'"{g}"', "5"], "null"), ("5", "C", 1, None, [f'"{g}"'], "null"),
    )
    assert rows(discovery.holders(src)) == sorted([("C", g), ("C", c)])


def test_template_keys(spark):
    a, b, d = keys(1), keys(2), keys(3)
    src = ev(
        spark, ("1", "C", 1, "t", ['"t"', f'"{a}"', f'["{b}",["{d}","{a[:-1]}"],{{"k":"{a}"}}]'], "null"),
        ("2", "C", 1, "t", ['"t"', f'"{a}"'], "null"), ("3", "C", 1, "u", ['"u"', '"x"'], "null"), ("4", "C", 1, "t", ['"t"', f'"{a}"', '{"k":1}'], "null"),
    )
    templates = spark.createDataFrame(
        [("Balance", ["t", "u"], [1], None, "bal"), ("Pair", ["t"], [1, 2], "temporary", None), ("None", ["t"], [9], None, None)],
        "symbol string, events array<string>, params array<int>, durability string, label string",
    )
    got = discovery.template_keys(src, templates)
    assert rows(got) == sorted([("C", "Balance", "persistent", "bal", [a]), ("C", "Pair", "temporary", None, [a, b]), ("C", "Pair", "temporary", None, [a, d])], key=repr)
    assert discovery.with_storage_key(got).where("key_hash is not null").count() == 3


def test_route_templates(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    cases = {f"/webhooks/{uuid}/retry": "/webhooks/{id}/retry", "/tx/42": "/tx/{id}", "/contracts/CABC/events": "/contracts/CABC/events", "/": "/", "": "/",
             "//a//-5": "/a/{id}", "/x/99999999999999999999": "/x/99999999999999999999", "/x/1.5": "/x/1.5"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert dict(rows(df.select("p", A.route_template(F.col("p"))))) == cases


def test_summaries_fold(spark):
    old = ev(spark, ("1", "C", 50, "x", [], ""), ("2", "D", 5, "x", [], ""))
    new = ev(spark, ("3", "C", 10, "x", [], ""), ("4", "E", 7, "x", [], ""))
    folded = A.merge_summaries(A.contract_summaries(old), new)
    assert rows(folded) == rows(A.contract_summaries(old.unionByName(new))) == [("C", 2, 10, 50), ("D", 1, 5, 5), ("E", 1, 7, 7)]
