"""HMAC-SHA256 from native expressions.

The padded key depends on the secret alone, so it is an expression over the
small subscription side; the two hash rounds run in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # SHA-256 block size in bytes


def _padded_key(secret: Column) -> Column:
    raw = F.encode(secret, "UTF-8")
    short = F.hex(raw)
    key = F.when(F.octet_length(raw) > BLOCK, F.sha2(raw, 256)).otherwise(short)
    return F.rpad(key, BLOCK * 2, "0")


def _xor_bytes(key_hex: Column, byte: int) -> Column:
    def one(i: Column) -> Column:
        value = F.conv(F.substring(key_hex, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.lpad(F.hex(value.bitwiseXOR(F.lit(byte)).cast("bigint")), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), one), ""))


def hmac_pads(secret: Column) -> Column:
    """Struct of the inner and outer padded keys."""
    key = _padded_key(secret)
    return F.struct(_xor_bytes(key, 0x36).alias("inner"), _xor_bytes(key, 0x5C).alias("outer"))


def hmac_sha256(pads: Column, message: Column) -> Column:
    """Hex HMAC of a text message under precomputed pads."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)
