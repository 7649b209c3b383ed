"""Opaque page positions: base64 of ``ledger|event_id``."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.wire import base64_text


class BadCursor(ValueError):
    """The caller's cursor cannot be read; never silently restart at page one."""


def encode_cursor(ledger: Column, event_id: Column) -> Column:
    return base64_text(F.encode(F.concat(ledger.cast("string"), F.lit("|"), event_id), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """Struct (ledger, event_id); null for a null or malformed cursor."""
    raw = F.try_to_binary(cursor, F.lit("base64"))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    cut = F.instr(text, "|")
    head = F.when(text.rlike(r"\A[+-]?[0-9]+\|"), F.substring(text, F.lit(1), cut - F.lit(1)))
    ledger = head.try_cast("bigint")
    return F.when(
        ledger.isNotNull(),
        F.struct(
            ledger.alias("ledger"),
            F.substring(text, cut + F.lit(1), F.length(text)).alias("event_id"),
        ),
    )


def position_of(cursor: str | None) -> tuple[int, str] | None:
    """Driver-side reading of one caller-supplied cursor."""
    if cursor is None:
        return None
    try:
        text = base64.b64decode(cursor, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError) as error:
        raise BadCursor(cursor) from error
    found = re.fullmatch(r"([+-]?\d+)\|(.*)", text, re.S | re.A)
    if not found or not -(2**63) <= int(found[1]) < 2**63:
        raise BadCursor(cursor)
    return int(found[1]), found[2]


def cursor_text(ledger: int, event_id: str) -> str:
    return base64.b64encode(f"{ledger}|{event_id}".encode()).decode()
