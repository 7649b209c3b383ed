import base64
import json

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wirebuild import account, b64, contract, i128, mapping, opaque, symbol, u32, vec

from eventloom.functions import cursor, wire

ZERO_CONTRACT = "CAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAABSC4"
ACCOUNT = "GBTHMMFWTAPFAHRGS33LKETZYJKBTNEENRN47EDZMZPT2BNCJO47GVQG"

GOLDEN = [
    ("AAAADwAAAANmZWUA", '"fee"'),
    ("AAAADwAAAAh0cmFuc2Zlcg==", '"transfer"'),
    ("AAAACgAAAAAAAAAAAAAAAAAAASw=", '"300"'),
    ("AAAACgAAAAAAAAAAAAAAAAAAAAA=", '"0"'),
    ("AAAAAwAAAAc=", "7"),
    ("AAAAAAAAAAE=", "true"),
    ("AAAAAAAAAAA=", "false"),
    ("AAAAAQ==", "null"),
    ("AAAAEgAAAAAAAAAAZnYwtpgeUB4mlva1EnnCVBm0hGxbz5B5Zl89BaJLufM=", f'"{ACCOUNT}"'),
    ("//8=", '{"_xdr":"//8="}'),
    ("not!valid!base64!!", '{"_xdr":"not!valid!base64!!"}'),
    ("", '{"_xdr":""}'),
    # i128 extremes stay exact.
    (b64(i128(2**127 - 1)), f'"{2**127 - 1}"'),
    (b64(i128(-(2**127))), f'"{-(2**127)}"'),
    (b64(u32(9) + b"\xff" * 16), f'"{2**128 - 1}"'),
    (b64(u32(2) + u32(1) + u32(2)), '{"_error":true}'),
    (b64(u32(4) + b"\xff" * 4), "-1"),
    (b64(u32(5) + b"\xff" * 8), f'"{2**64 - 1}"'),
    (b64(u32(6) + b"\xff" * 8), '"-1"'),
    (b64(u32(7) + b"\0" * 7 + b"\5"), '"5"'),
    (b64(u32(8) + b"\0" * 7 + b"\6"), '"6"'),
    (b64(u32(11) + b"\1" * 32), json.dumps({"_u256_hex": "01" * 32}, separators=(",", ":"))),
    (b64(u32(13) + opaque(b"\x0a\xff")), '"0x0aff"'),
    (b64(u32(14) + opaque("héllo")), '"héllo"'),
    (b64(u32(14) + opaque(b"\xff\xfe")), '"0xfffe"'),
    (b64(u32(15) + opaque(b"\xff\xfe")), None),
    (b64(u32(16) + u32(0)), "[]"),
    (b64(u32(17) + u32(0)), "{}"),
    (b64(vec(symbol("a"), u32(3) + u32(1), u32(1))), '["a",1,null]'),
    (b64(mapping((symbol("b"), u32(1)), (symbol("a"), i128(5)))), '{"a":"5","b":null}'),
    (b64(mapping((u32(3) + u32(1), symbol("x")))), '[{"key":1,"val":"x"}]'),
    (b64(u32(18) + u32(7)), '"_addr_type_7"'),
    (b64(u32(99)), '{"_xdr_tag":99}'),
    # Only the first value counts.
    (b64(symbol("fee") + b"junk"), '"fee"'),
    # A vector that claims more items than there are bytes.
    (b64(u32(16) + u32(1) + u32(2**31)), None),
    (b64((u32(16) + u32(1) + u32(1)) * 300 + u32(1)), "[" * 300 + "null" + "]" * 300),
]


def test_golden_values(spark):
    df = spark.createDataFrame([(a,) for a, _ in GOLDEN], "v string")
    got = dict(rows(df.select("v", wire.decode_scval(F.col("v")))))
    for text, want in GOLDEN:
        assert got[text] == (want if want is not None else json.dumps({"_xdr": text}, separators=(",", ":")))


def test_null_and_lists(spark):
    df = spark.createDataFrame([(["AAAADwAAAANmZWUA", None, "!"],), ([],), (None,), (["AAAAAQ=="],)], "t array<string>")
    got = [r[0] for r in df.select(wire.decode_topics(F.col("t"))).collect()]
    assert got == [['"fee"', None, '{"_xdr":"!"}'], [], None, ["null"]]


def test_event_name(spark):
    df = spark.createDataFrame(
        [(['"transfer"'],), (["7"],), ([],), (['"a\\"b"'],), (['{"a":1}'],), (["null"],), (['""'],)], "t array<string>"
    )
    got = [r[0] for r in df.select(wire.event_name(F.col("t"))).collect()]
    assert got == ["transfer", None, None, 'a"b', None, None, ""]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_never_fails_on_bytes(raw):
    json.loads(wire.value_json(base64.b64encode(raw).decode()))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_never_fails_on_text(text):
    json.loads(wire.value_json(text))


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**127), 2**127 - 1))
def test_i128_round_trip(n):
    assert wire.value_json(b64(i128(n))) == f'"{n}"'


def test_addresses(spark):
    good_g = wire.encode_strkey(wire.ACCOUNT_VERSION, bytes([1]) * 32)
    good_c = wire.encode_strkey(wire.CONTRACT_VERSION, bytes([2]) * 32)
    assert wire.encode_strkey(wire.CONTRACT_VERSION, bytes(32)) == ZERO_CONTRACT
    texts = [ZERO_CONTRACT, good_c, "CDLZFC3SYJYDZT7K67VZ75HPJVIEUVNIXF47ZG2FB2RMQQVU2HHGCYSC", good_g, ACCOUNT, ZERO_CONTRACT[:-1],
             ZERO_CONTRACT + "A", "x", "", None, ZERO_CONTRACT.lower()]
    changed = [good_c[:i] + ("A" if good_c[i] != "A" else "B") + good_c[i + 1 :] for i in range(56)]
    odd = [good_c[:10] + c + good_c[11:] for c in "018!"]
    df = spark.createDataFrame([(t,) for t in texts + changed + odd], "t string")
    got = [tuple(r) for r in df.select(wire.is_valid_contract_id(F.col("t")), wire.is_address(F.col("t"))).collect()]
    assert got[:5] == [(True, True)] * 3 + [(False, True)] * 2
    assert set(got[5:]) == {(False, False)}


def test_strkey_column(spark):
    df = spark.createDataFrame([(bytes(32),), (b"short",), (None,)], "b binary")
    got = [r[0] for r in df.select(wire.strkey(wire.CONTRACT_VERSION, F.col("b"))).collect()]
    assert got == [ZERO_CONTRACT, None, None]


def test_storage_key(spark):
    import hashlib

    g, c = wire.encode_strkey(0x30, bytes([1]) * 32), wire.encode_strkey(0x10, bytes([2]) * 32)
    df = spark.createDataFrame([([g],), ([g, c],), (["bad"],), ([g, "bad"],)], "a array<string>")
    got = [r["k"] for r in df.select(wire.storage_key(F.lit("Allowance"), F.col("a")).alias("k")).collect()]
    want = b64(vec(symbol("Allowance"), account(1), contract(2)))
    assert got[1]["key_xdr"] == want
    assert got[1]["key_hash"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["key_json"] == wire.value_json(want)
    assert got[0]["key_xdr"] == b64(vec(symbol("Allowance"), account(1)))
    assert got[2] is None and got[3] is None


def test_cursors(spark):
    assert cursor.position_of(cursor.cursor_text(42, "abc")) == (42, "abc")
    assert cursor.position_of(None) is None
    for bad in ("!!!not-base64!!!", b64(b"no separator"), b64(b"x|id"), b64(b"\xff|a"), b64(str(2**63).encode() + b"|a")):
        with pytest.raises(cursor.BadCursor):
            cursor.position_of(bad)
    df = spark.createDataFrame([(b64(b"42|abc|d"),), ("!!!",), (b64(b"x|id"),), (None,), (b64(b"\xff|a"),), (b64(b"-7|"),)], "c string")
    got = [r[0] for r in df.select(cursor.decode_cursor(F.col("c"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(42, "abc|d"), None, None, None, None, (-7, "")]
