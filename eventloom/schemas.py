"""Table shapes. JSON islands are canonical JSON text: sorted keys, no spaces."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, FLAG, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    # Built from types, not DDL text, so importing needs no session.
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def array(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


TEXTS = T.ArrayType(TEXT)

EVENTS = struct(
    event_id=TEXT, contract_id=TEXT, ledger=LONG, ledger_closed_at=TIME, event_type=TEXT, topics=TEXTS, decoded_topics=TEXTS,
    event_name=TEXT, value=TEXT, decoded_value=TEXT, enriched=TEXT, tx_hash=TEXT, in_successful_call=FLAG, paging_token=TEXT,
    created_at=TIME,
)
EVENT_COLUMNS = tuple(EVENTS.names)

# One saved page of the node's event listing.
PAGE = struct(
    latestLedger=LONG,
    events=array(
        type=TEXT, ledger=LONG, ledgerClosedAt=TEXT, contractId=TEXT, id=TEXT, pagingToken=TEXT, inSuccessfulContractCall=FLAG,
        txHash=TEXT, topic=TEXTS, value=TEXT,
    ),
    cursor=TEXT,
)

# Ledger-entry dumps: instance entries carry storage, data entries carry key and val.
ENTRY = struct(
    contract_id=TEXT, wasm_hash=TEXT, storage=TEXT, key=TEXT, durability=TEXT, val=TEXT, last_modified_ledger=LONG
)

INTERFACE = struct(
    functions=array(name=TEXT, doc=TEXT, inputs=array(name=TEXT, type=TEXT), outputs=TEXTS),
    events=array(
        name=TEXT, doc=TEXT, prefix_topics=TEXTS, params=array(name=TEXT, type=TEXT, location=TEXT, shape=TEXT), data_format=TEXT
    ),
    structs=array(name=TEXT, fields=array(name=TEXT, type=TEXT)),
    unions=array(name=TEXT, cases=array(name=TEXT, types=TEXTS)),
    enums=array(name=TEXT, cases=array(name=TEXT, value=LONG)),
    # Definitions of user types by name, as JSON, for naming decoded values.
    type_defs=TEXT,
)

SUMMARIES = struct(contract_id=TEXT, event_count=LONG, first_seen_ledger=LONG, last_seen_ledger=LONG)

DELIVERIES = struct(
    id=LONG, subscription_id=TEXT, event_id=TEXT, upgrade_id=LONG, status=TEXT, attempts=INT, last_error=TEXT,
    next_attempt_at=TIME, delivered_at=TIME, created_at=TIME,
)
# Queued rows get their id when they are sent.
QUEUED = T.StructType(DELIVERIES.fields[1:])
TAIL = struct(ledger=LONG, event_id=TEXT, payload=TEXT)
