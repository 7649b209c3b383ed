"""Small native helpers over canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def canonical(col: Column) -> Column:
    """Sorted keys, no spaces; null when the text is not JSON."""
    return F.to_json(F.try_parse_json(col))


def text_of(json_col: Column) -> Column:
    """The string inside a JSON string; null for any other JSON value."""
    # Without an escape the only quotes are the outer ones.
    parsed = F.get_json_object(json_col, "$")
    plain = F.replace(json_col, F.lit('"'), F.lit(""))
    return F.when(json_col.startswith('"'), F.when(json_col.contains("\\"), parsed).otherwise(plain))


def quote(col: Column) -> Column:
    """JSON string literal for a text column; null stays null."""
    wrapped = F.to_json(F.array(col))
    return F.when(col.isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - F.lit(2)))


def array_text(items: Column) -> Column:
    """An array of JSON texts as one JSON array text."""
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def topic(decoded_topics: Column | str, position: int) -> Column:
    """Zero-based decoded topic, null when absent."""
    return F.get(decoded_topics, F.lit(position))


def topic_text(decoded_topics: Column | str, position: int) -> Column:
    return text_of(topic(decoded_topics, position))


def iso_text(col: Column) -> Column:
    """Timestamp as RFC 3339 text with microseconds, the form used in payloads."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
