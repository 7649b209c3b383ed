"""Depth and length have no bounds of our own; white space of any kind is white space."""

import json
import struct

from conftest import rows
from pyspark.sql import functions as F

from eventloom.functions import deepjson, interface, wire
from eventloom.functions.jsontext import stripped
from eventloom.operators import deliveries as D


def nested(depth):
    return b"".join([struct.pack(">III", 16, 1, 1)] * depth) + struct.pack(">I", 1)


def test_deep_values_are_read():
    for depth in (150, 250, 5000):
        text, at = wire.read_json(nested(depth))
        assert text == "[" * depth + "null" + "]" * depth and at == len(nested(depth))


def test_maps_keep_the_last_of_equal_keys_and_sort():
    def symbol(s):
        return struct.pack(">II", 15, len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def u32(n):
        return struct.pack(">II", 3, n)

    body = struct.pack(">III", 17, 1, 3) + symbol("b") + u32(1) + symbol("a") + u32(2) + symbol("b") + u32(3)
    assert json.loads(wire.read_json(body)[0]) == {"a": 2, "b": 3} and wire.read_json(body)[0] == '{"a":2,"b":3}'
    odd = struct.pack(">III", 17, 1, 1) + u32(7) + symbol("x")
    assert wire.read_json(odd)[0] == '[{"key":7,"val":"x"}]'
    assert wire.read_json(struct.pack(">II", 16, 0))[0] == "[]" and wire.read_json(struct.pack(">II", 17, 0))[0] == "{}"


def test_deep_types_and_long_lists():
    deep = b"".join([struct.pack(">I", 1002)] * 2000) + struct.pack(">I", 4)
    assert interface._Reader(deep).type()[0] == "Vec<" * 2000 + "u32" + ">" * 2000
    wide = struct.pack(">II", 1005, 60) + struct.pack(">I", 4) * 60
    assert interface._Reader(wide).type()[0].count("u32") == 60


def test_deep_json_is_read_and_written():
    odd = {"b": [1, {"a": 'x]{,:\\"', "é": None}, [], {}, -2.5, True], "": "q"}
    text = json.dumps(odd, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert deepjson._read(text) == odd and deepjson._write(odd) == text == deepjson.dump(odd)
    for inner in ("7", '{"k":["a"]}'):
        text = "[" * 200_000 + inner + "]" * 200_000
        assert deepjson.dump(deepjson.load(text)) == text
    text = '{"a":' * 50_000 + "1" + "}" * 50_000
    assert deepjson.dump(deepjson.load(text)) == text
    assert deepjson.load("5") == 5 and deepjson._read('"x"') == "x" and deepjson._write([]) == "[]"


def test_deep_values_are_relabelled(spark):
    """No depth keeps its numbers: neither of the value, nor of the type."""
    depth = 3_000
    shape = ["udt", "Stage"]
    for _ in range(depth):
        shape = ["vec", shape]
    defs = '{"Node":["struct",[["next",["udt","Node"]],["state",["udt","Stage"]]]],"Stage":["enum",{"7":"Done"}]}'
    chain = '{"next":' * depth + "null" + ',"state":7}' * depth
    given = [("[" * depth + "7" + "]" * depth, deepjson.dump(shape), "[" * depth + '"Done"' + "]" * depth), (chain, '["udt","Node"]', chain.replace("7", '"Done"'))]
    df = spark.createDataFrame([([v], [s], defs) for v, s, _ in given], "v array<string>, s array<string>, d string")
    got = df.select(interface.relabel(F.col("v"), F.col("s"), F.col("d")).alias("r")).collect()
    assert [r.r for r in got] == [[want] for _, _, want in given]


def test_all_white_space_is_stripped(spark):
    texts = ["\t# note", " x ", " \t\r\n", "a b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.s for r in df.select(stripped(F.col("v")).alias("s")).collect()] == ["# note", "x", "", "a b", "", None]


def test_repeated_outcomes_count_once(spark):
    queue = spark.createDataFrame([("d1", 0, "pending"), ("d2", 0, "pending")], "id string, attempts int, status string")
    queue = queue.select("*", F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("delivered_at"))
    told = spark.createDataFrame([("d1", False, "late", 1), ("d1", True, None, 2), ("d2", False, "x", 5), ("d2", False, "x", 5)], "delivery_id string, ok boolean, error string, at int")
    out = D.apply_outcomes(queue, told, F.timestamp_seconds(F.lit(0)), jitter="none")
    assert rows(out, "id", "attempts", "status", "last_error") == [("d1", 1, "delivered", None), ("d2", 1, "pending", "x")]
