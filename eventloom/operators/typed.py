"""Typed view of one contract's events: columns with the types its interface declares.

Enriched records hold canonical JSON; for one contract and event the declared
parameters give a struct type, so a record is opened once and every parameter
becomes a column of its own type. Texts that hold numbers (64 bits and more)
become numbers where the engine has a type for them. A parameter that does not
fit its type is null.

| declared | column |
| --- | --- |
| bool | boolean |
| u32, i64, Duration | long |
| i32 | int |
| u64 | decimal(20,0) |
| Timepoint | timestamp |
| u128, i128 | text: 39 digits fit no decimal type |
| Bytes, String, Symbol, Address, MuxedAddress, enums, 256-bit values | text |
| Vec<T> | array of T |
| Map<K, V> | map from text to V where K is text or a number, else text |
| Option<T> | T |
| struct | struct of its fields, by name |
| tuples, unions, Result, Val, Error, BytesN, unknown names, types that hold themselves | text (JSON unless a string) |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How declared scalar types read.
SCALARS = {
    "bool": T.BooleanType(), "u32": T.LongType(), "i32": T.IntegerType(), "u64": T.DecimalType(20, 0), "i64": T.LongType(), "Duration": T.LongType(),
    "Timepoint": T.TimestampType(),
}
KEYS = ("Symbol", "String", "Address", "Bytes", "u32", "i32", "u64", "i64", "u128", "i128")


def _arguments(text: str) -> list[str]:
    """Top-level arguments of ``Name<...>``."""
    inner = text[text.index("<") + 1:-1]
    out, level, start = [], 0, 0
    for i, c in enumerate(inner):
        level += (c == "<") - (c == ">") + (c == "(") - (c == ")")
        if c == "," and not level:
            out.append(inner[start:i].strip())
            start = i + 1
    return [*out, inner[start:].strip()]


def column_type(declared: str, structs: dict[str, list[tuple[str, str]]], inside: tuple[str, ...] = ()) -> T.DataType:
    """Type of a declared type; ``structs`` has the fields of each user struct."""
    if declared in SCALARS:
        return SCALARS[declared]
    if declared.startswith("Option<"):
        return column_type(_arguments(declared)[0], structs, inside)
    if declared.startswith("Vec<"):
        return T.ArrayType(column_type(_arguments(declared)[0], structs, inside))
    if declared.startswith("Map<"):
        key, value = _arguments(declared)
        return T.MapType(T.StringType(), column_type(value, structs, inside)) if key in KEYS else T.StringType()
    fields = structs.get(declared)
    if fields and declared not in inside and all(not name.isdigit() for name, _ in fields):
        return T.StructType([T.StructField(name, column_type(kind, structs, (*inside, declared))) for name, kind in fields])
    return T.StringType()


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with texts at its ends, as JSON is read."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _as_text(kind.valueType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    return T.StringType()


def _typed(value: Column, kind: T.DataType) -> Column:
    """A value read as texts, with the types at its ends."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _typed(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_typed(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(value.try_cast("bigint"))
    return value if isinstance(kind, T.StringType) else value.try_cast(kind)


def event_type(interface: Row, event: str) -> T.StructType:
    """Parameters of an event as a struct type, in declared order; of equal names the last stands."""
    structs = {s["name"]: [(f["name"], f["type"]) for f in s["fields"]] for s in reversed(interface["structs"] or [])}
    spec = next((e for e in interface["events"] or [] if e["name"] == event), None)
    if spec is None:
        raise ValueError(f"the interface has no event {event}")
    params = {p["name"]: p["type"] for p in spec["params"]}
    return T.StructType([T.StructField(name, column_type(kind, structs)) for name, kind in params.items()])


def typed_events(ev: DataFrame, contract_id: str, interface: Row, event: str, keep: tuple[str, ...] = ("event_id", "ledger", "ledger_closed_at")) -> DataFrame:
    """One contract's enriched events of a name: ``keep`` columns and ``params``, a typed struct."""
    kind = event_type(interface, event)
    record = T.StructType([
        T.StructField("event", T.StringType()),
        T.StructField("params", T.StructType([T.StructField(f.name, T.StructType([T.StructField("value", _as_text(f.dataType))])) for f in kind.fields])),
    ])
    opened = ev.where((F.col("contract_id") == contract_id) & F.col("enriched").isNotNull()).select(*keep, F.from_json("enriched", record).alias("r"))
    found = opened.where(F.col("r.event") == event)
    values = [_typed(F.col("r.params").getField(f.name).getField("value"), f.dataType).alias(f.name) for f in kind.fields]
    return found.select(*keep, F.struct(*values).alias("params"))
