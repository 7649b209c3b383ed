"""Column functions over the tagged big-endian value format.

Reading a value is recursive, so it runs in Arrow batches in Python. A batch is
dictionary-encoded first: event names, addresses and contract ids repeat
heavily, so each distinct text of a batch is read once. Everything that has a
fixed layout (writing keys, hashing, name tests) stays in native expressions.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.deepjson import dump

# Fixed values of the wire format.
# Scalar tags: (struct layout, rendering).
SCALARS: dict[int, tuple[str, Callable]] = {
    0: (">I", lambda n: n != 0),
    1: (">", lambda: None),
    2: (">II", lambda kind, code: {"_error": True}),
    3: (">I", int),
    4: (">i", int),
    5: (">Q", str),
    6: (">q", str),
    7: (">Q", str),
    8: (">Q", str),
    9: (">QQ", lambda hi, lo: str((hi << 64) + lo)),
    10: (">qQ", lambda hi, lo: str((hi << 64) + lo)),
    11: (">32s", lambda raw: {"_u256_hex": raw.hex()}),
    12: (">32s", lambda raw: {"_u256_hex": raw.hex()}),
}
BYTES, STRING, SYMBOL, VEC, MAP, ADDRESS = 13, 14, 15, 16, 17, 18
ACCOUNT_VERSION = 0x30  # "G..."
CONTRACT_VERSION = 0x10  # "C..."
# Address kinds: (bytes before the key, version byte).
ADDRESS_KINDS = {0: (4, ACCOUNT_VERSION), 1: (0, CONTRACT_VERSION)}


class Malformed(ValueError):
    """The bytes are not one well-formed value."""


def encode_strkey(version: int, payload: bytes) -> str:
    body = bytes([version]) + payload
    check = binascii.crc_hqx(body, 0).to_bytes(2, "little")
    return base64.b32encode(body + check).decode().rstrip("=")


def decode_strkey(text: str) -> tuple[int, bytes] | None:
    """(version, 32-byte key) of a well-formed 56-character key text, else None."""
    if len(text) != 56:
        return None
    try:
        raw = base64.b32decode(text)
    except (binascii.Error, ValueError):
        return None
    if binascii.crc_hqx(raw[:33], 0) != int.from_bytes(raw[33:], "little"):
        return None
    return raw[0], raw[1:33]


def _unpack(layout: str, buf: bytes, at: int) -> tuple[tuple, int]:
    try:
        return struct.unpack_from(layout, buf, at), at + struct.calcsize(layout)
    except struct.error as error:
        raise Malformed from error


def read_opaque(buf: bytes, at: int) -> tuple[bytes, int]:
    """Length-prefixed bytes, zero-padded to four."""
    (size,), at = _unpack(">I", buf, at)
    end = at + size
    padded = end + -size % 4
    if padded > len(buf):
        raise Malformed
    return buf[at:end], padded


def _plain(buf: bytes, at: int, tag: int) -> tuple[object, int]:
    """A value that holds no other values, as plain Python data."""
    if tag in SCALARS:
        layout, render = SCALARS[tag]
        fields, at = _unpack(layout, buf, at)
        return render(*fields), at
    if tag == ADDRESS:
        (kind,), at = _unpack(">I", buf, at)
        if kind not in ADDRESS_KINDS:
            return f"_addr_type_{kind}", at
        skip, version = ADDRESS_KINDS[kind]
        (_, key), at = _unpack(f">{skip}s32s", buf, at)
        return encode_strkey(version, key), at
    if tag in (BYTES, STRING, SYMBOL):
        raw, at = read_opaque(buf, at)
        if tag != BYTES:
            try:
                return raw.decode("utf-8"), at
            except UnicodeDecodeError as error:
                if tag == SYMBOL:
                    raise Malformed from error
        return "0x" + raw.hex(), at
    return {"_xdr_tag": tag}, at


def _list_text(items: list[tuple[str, str | None]]) -> str:
    return f"[{','.join(text for text, _ in items)}]"


def _map_text(items: list[tuple[str, str | None]]) -> str:
    """Keys and values in turn; an object if all keys are texts (the last of equal keys stands), else a list of pairs."""
    keys, values = items[::2], items[1::2]
    if all(key is not None for _, key in keys):
        named = {key: (text, value) for (text, key), (value, _) in zip(keys, values)}
        return "{" + ",".join(f"{text}:{value}" for _, (text, value) in sorted(named.items())) + "}"
    return "[" + ",".join(f'{{"key":{key},"val":{value}}}' for (key, _), (value, _) in zip(keys, values)) + "]"


def read_json(buf: bytes, at: int = 0) -> tuple[str, int]:
    """Canonical JSON of one value, with the position after it.

    Open lists and maps stand on a stack of their own, so depth has no bound.
    """
    open_: list[list] = []  # [tag, values left, items]
    while True:
        (tag,), at = _unpack(">I", buf, at)
        if tag in (VEC, MAP):
            (present,), at = _unpack(">I", buf, at)
            count = 0
            if present:
                (count,), at = _unpack(">I", buf, at)
            open_.append([tag, count * (2 if tag == MAP else 1), []])
        else:
            value, at = _plain(buf, at, tag)
            if not open_:
                return dump(value), at
            open_[-1][1] -= 1
            open_[-1][2].append((dump(value), value if isinstance(value, str) else None))
        while open_ and not open_[-1][1]:
            tag, _, items = open_.pop()
            text = _map_text(items) if tag == MAP else _list_text(items)
            if not open_:
                return text, at
            open_[-1][1] -= 1
            open_[-1][2].append((text, None))


def value_json(text: str) -> str:
    """Canonical JSON of one base64 value; unreadable input is kept as an object."""
    try:
        raw = binascii.a2b_base64(text, strict_mode=True)
        # Reject spellings the encoder would never write (loose trailing bits).
        if binascii.b2a_base64(raw, newline=False).decode() != text:
            raise Malformed
        return read_json(raw)[0]
    except (Malformed, ValueError):
        return dump({"_xdr": text})


def per_distinct(column: pa.Array, fn: Callable, out: pa.DataType) -> pa.Array:
    """Apply ``fn`` once per distinct value of an Arrow batch; null stays null."""
    encoded = column.dictionary_encode()
    results = pa.array([fn(v) for v in encoded.dictionary.to_pylist()], out)
    return results.take(encoded.indices)


@F.arrow_udf(T.StringType())
def _decode_batch(column: pa.Array) -> pa.Array:
    return per_distinct(column, value_json, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode_list_batch(column: pa.Array) -> pa.Array:
    # flatten() drops the slots of null lists; offsets are rebuilt from lengths.
    flat = per_distinct(column.flatten(), value_json, pa.string())
    at, offsets = 0, [0]
    for size in column.value_lengths().fill_null(0).to_pylist():
        at += size
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=column.is_null())


def _strkey_batch(version: int):
    @F.arrow_udf(T.StringType())
    def batch(column: pa.Array) -> pa.Array:
        return per_distinct(
            column, lambda raw: encode_strkey(version, raw) if len(raw) == 32 else None, pa.string()
        )

    return batch


@F.arrow_udf(T.BooleanType())
def _checksum_batch(column: pa.Array) -> pa.Array:
    return per_distinct(column, lambda text: decode_strkey(text) is not None, pa.bool_())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _keys_batch(column: pa.Array) -> pa.Array:
    def key(text):
        found = decode_strkey(text) if text is not None else None
        return found[1] if found else None

    return pa.array(
        [None if row is None else [key(text) for text in row] for row in column.to_pylist()],
        pa.list_(pa.binary()),
    )


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _good_addresses_batch(column: pa.Array) -> pa.Array:
    flat = column.flatten().flatten()
    good = dict.fromkeys(t for t in flat.unique().to_pylist() if t and t[0] in "GC" and decode_strkey(t))
    rows = column.to_pylist()
    kept = [None if r is None else [None if one is None else [t for t in one if t in good] for one in r] for r in rows]
    return pa.array(kept, pa.list_(pa.list_(pa.string())))


# A string, or a brace outside of strings.
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def listed_texts(topic: str | None) -> list[str]:
    """The string of a string topic, or all strings of a list nested to any depth.

    Objects are not searched, wherever they stand: strings between braces are
    passed over, however deep.
    """
    if not topic or topic[0] not in '"[':
        return []
    found, inside = [], 0
    for part in _PARTS.findall(topic):
        if part == "{":
            inside += 1
        elif part == "}":
            inside -= 1
        elif not inside:
            found.append(json.loads(part))
    return found


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _texts_batch(column: pa.Array) -> pa.Array:
    return pa.array([None if row is None else [listed_texts(t) for t in row] for row in column.to_pylist()], pa.list_(pa.list_(pa.string())))


def flat_texts(topics: Column) -> Column:
    """Per topic (canonical JSON) of an array: its strings outside of objects."""
    return _texts_batch(topics)


def good_addresses(texts: Column) -> Column:
    """Per list of an array of lists: its elements that are addresses."""
    return _good_addresses_batch(texts)


def decode_scval(col: Column) -> Column:
    """base64 wire value -> canonical JSON text; never fails."""
    return _decode_batch(col)


def decode_topics(col: Column) -> Column:
    """Element-wise decode of an array of base64 values, order kept."""
    return _decode_list_batch(col)


def event_name(decoded_topics: Column) -> Column:
    """First topic when it is a JSON string, else null."""
    from eventloom.functions.jsontext import topic_text

    return topic_text(decoded_topics, 0)


def strkey(version: int, payload: Column) -> Column:
    """Key text of a 32-byte binary column; null for other lengths."""
    return _strkey_batch(version)(payload)


def _shaped(col: Column, first: str) -> Column:
    # Length and alphabet are settled natively; the version byte fixes the
    # first character and limits the second to A-D.
    return col.rlike(f"\\A[{first}][A-D][A-Z2-7]{{54}}\\z")


def is_valid_contract_id(col: Column) -> Column:
    return F.coalesce(_checksum_batch(F.when(_shaped(col, "C"), col)), F.lit(False))


def is_address(col: Column) -> Column:
    """Account (G) or contract (C) key text with a good checksum."""
    return F.coalesce(_checksum_batch(F.when(_shaped(col, "GC"), col)), F.lit(False))


# ---- writing values: fixed layouts, so plain expressions over hex text --------


def hex_u32(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 8, "0")


def hex_opaque(raw: Column) -> Column:
    """Length, bytes and zero padding of a binary column, as hex text."""
    size = F.octet_length(raw)
    return F.concat(hex_u32(size), F.hex(raw), F.repeat(F.lit("00"), F.pmod(-size, F.lit(4))))


def hex_text(col: Column) -> Column:
    return hex_opaque(F.encode(col, "UTF-8"))


def hex_symbol(col: Column) -> Column:
    return F.concat(F.lit("0000000F"), hex_text(col))


def hex_address(key_text: Column, key: Column) -> Column:
    kind = F.when(key_text.startswith("C"), F.lit("00000001")).otherwise(F.lit("0" * 16))
    return F.concat(F.lit("00000012"), kind, F.hex(key))


def hex_i128(n: Column) -> Column:
    """A bigint column as a signed 128-bit value."""
    high = F.when(n < 0, F.lit("F" * 16)).otherwise(F.lit("0" * 16))
    return F.concat(F.lit("0000000A"), high, F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def base64_text(raw: Column) -> Column:
    """base64 on one line; Spark breaks long texts every 76 characters."""
    return F.translate(F.base64(raw), "\r\n", "")


def base64_of(hex_col: Column) -> Column:
    return base64_text(F.unhex(hex_col))


def storage_key(symbol: Column, addresses: Column) -> Column:
    """Storage key of ``[symbol, address...]``.

    A struct of key_xdr (base64), key_hash (SHA-256 hex of that text) and
    key_json; null when any address is malformed.
    """
    from eventloom.functions.jsontext import array_text, quote

    keys = _keys_batch(addresses)
    parts = F.zip_with(addresses, keys, hex_address)
    body = F.concat(
        F.lit("0000001000000001"),
        hex_u32(F.size(addresses) + F.lit(1)),
        hex_symbol(symbol),
        F.array_join(parts, ""),
    )
    xdr = base64_of(body)
    return F.when(
        ~F.exists(keys, lambda k: k.isNull()),
        F.struct(
            xdr.alias("key_xdr"),
            F.sha2(F.encode(xdr, "UTF-8"), 256).alias("key_hash"),
            array_text(F.concat(F.array(quote(symbol)), F.transform(addresses, quote))).alias("key_json"),
        ),
    )
