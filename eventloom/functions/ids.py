"""Ledger positions inside event ids.

An id is ``<position>-<index>``; the position is a decimal number with the
ledger in its upper 32 bits. Other ids encode no ledger.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
LEDGER_SHIFT = 32
POSITION_WIDTH, INDEX_WIDTH = 19, 10

_ENCODED = re.compile(r"([0-9]{1,19})-[0-9]+")


def ledger_of(event_id: Column) -> Column:
    """Ledger of an id, null where it encodes none."""
    position = F.regexp_extract(event_id, r"^([0-9]{1,19})-[0-9]+$", 1).try_cast("bigint")
    ledger = F.shiftright(position, LEDGER_SHIFT)
    return F.when(ledger > 0, ledger)


def ledger_in(event_id: str) -> int | None:
    """The same for one id on the driver."""
    found = _ENCODED.fullmatch(event_id)
    position = int(found[1]) if found else 0
    return position >> LEDGER_SHIFT or None if position < 1 << 63 else None


def event_id_at(ledger: Column, order: Column, index: Column) -> Column:
    """Id of an event: ``order`` numbers the operations of its ledger, ``index`` the events of one."""
    position = F.shiftleft(ledger.cast("bigint"), LEDGER_SHIFT) + order
    return F.concat(F.lpad(position.cast("string"), POSITION_WIDTH, "0"), F.lit("-"), F.lpad(index.cast("string"), INDEX_WIDTH, "0"))
