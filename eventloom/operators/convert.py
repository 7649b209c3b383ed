"""Raw events of any source -> decoded events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.once import computed_once
from eventloom.functions.wire import decode_scval, decode_topics, event_name
from eventloom.operators.enrich import enrich
from eventloom.schemas import EVENT_COLUMNS

# RFC 3339 with a zone; the shape is checked because casts accept bare dates.
RFC3339 = r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"


def close_time(text):
    upper = F.upper(text)
    return F.when(upper.rlike(RFC3339), upper.try_cast("timestamp"))


def to_events(raw: DataFrame, interfaces: DataFrame | None = None, created_at=None) -> DataFrame:
    """Decoded event rows plus ``bad_close_time``.

    ``raw`` has the source columns (close time as text or timestamp). A close
    time that cannot be read becomes null and is flagged.
    """
    is_text = dict(raw.dtypes)["ledger_closed_at"] == "string"
    closed = close_time(F.col("ledger_closed_at")) if is_text else F.col("ledger_closed_at").cast("timestamp")
    plain = raw.select(
        "event_id", "contract_id", F.col("ledger").cast("bigint").alias("ledger"), closed.alias("ledger_closed_at"), "event_type", "topics", "value",
        "tx_hash", "in_successful_call", F.coalesce(F.nullif("paging_token", F.lit("")), F.col("event_id")).alias("paging_token"),
    )
    # Filters on what is decoded stay above, so a value is read once.
    decoded = computed_once(plain, *plain.columns, decoded_topics=decode_topics(F.col("topics")), decoded_value=decode_scval(F.col("value")))
    events = decoded.withColumn("event_name", event_name(F.col("decoded_topics")))
    if interfaces is None:
        events = events.withColumn("enriched", F.lit(None).cast("string"))
    else:
        events = enrich(events, interfaces)
    stamp = F.col("ledger_closed_at") if created_at is None else created_at
    return (
        events.withColumn("created_at", stamp)
        .withColumn("bad_close_time", F.col("ledger_closed_at").isNull())
        .select(*EVENT_COLUMNS, "bad_close_time")
    )
