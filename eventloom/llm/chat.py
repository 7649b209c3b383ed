"""Chat formatting with a grammar round trip, in built-in expressions only.

The grammar: a conversation is a row of turns. A turn of the assistant is
``<s>role\\ntext</s>``, any other turn ``[INST]role\\ntext[/INST]``. The parser
is deterministic: it reads the next opening mark, then the shortest content up
to the mark that closes it; the first line break not behind a backslash ends
the role; at last each backslash is taken away, what follows it stands.

Conversations are first rendered as they are and parsed again. Where the turns
found differ from the source, or control strings stand in the contents, the
contents are escaped (a backslash goes before each backslash and behind the
first character of each control string) and rendered again. Escaping leaves no
control string and is undone by the parser, so the second rendering always
agrees; ``agrees`` says that it was compared and found identical. The loss mask
is a list of spans of the formatted text: the texts of assistant turns.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text), nulls first, and repeated rows are turns of their own; rows with a null
conv_id are one conversation; an empty table gives an empty result; other
columns than conv_id, turn, role and text are not read. A conversation is one
output text, so its turns meet in one row; conversations spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query, table

# Fixed values of the template.
ASSISTANT = "assistant"
OPEN_TURN, CLOSE_TURN = "[INST]", "[/INST]"
OPEN_REPLY, CLOSE_REPLY = "<s>", "</s>"

CONTROL = r"\[/?INST\]|</?s>"
# The place behind the first character of a control string.
INSIDE = r"(?<=\[)(?=/?INST\])|(?<=<)(?=/?s>)"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
ROLE = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), INSIDE, r"\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: bool) -> Column:
    """One formatted part per turn (structs role, text)."""

    def part(t: Column) -> Column:
        role, text = (escape_role(t["role"]), escape(t["text"])) if escaped else (t["role"], t["text"])
        reply = t["role"] == ASSISTANT
        return F.concat(
            F.when(reply, OPEN_REPLY).otherwise(OPEN_TURN), role, F.lit("\n"), text, F.when(reply, CLOSE_REPLY).otherwise(CLOSE_TURN)
        )

    return F.transform(turns, part)


def _content(found: Column) -> Column:
    """What stands between the marks of a turn."""
    reply = F.startswith(found, F.lit(OPEN_REPLY))
    head = F.when(reply, len(OPEN_REPLY)).otherwise(len(OPEN_TURN))
    tail = F.when(reply, len(CLOSE_REPLY)).otherwise(len(CLOSE_TURN))
    return F.substring(found, head + 1, F.length(found) - head - tail)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""

    def turn(content: Column) -> Column:
        role = F.regexp_extract(content, ROLE, 1)
        text = F.substring(content, F.length(role) + 2, F.length(content))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), _content), turn)


def loss_spans(parts: Column) -> Column:
    """(start, length) in the formatted text, from 0, of each assistant text."""
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def add(acc: Column, part: Column) -> Column:
        head = F.lit(len(OPEN_REPLY)) + F.length(F.regexp_extract(_content(part), ROLE, 1)) + 1
        span = F.struct((acc["at"] + head).cast("long").alias("start"), (F.length(part) - head - len(CLOSE_REPLY)).cast("long").alias("length"))
        spans = F.when(F.startswith(part, F.lit(OPEN_REPLY)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, parts, formatted, parsed (turns read back), escaped, agrees."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    source = source.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), False))
    tried = plain.withColumn("found", parse(F.array_join("plain", "")))
    marked = F.exists("turns", lambda t: F.rlike(t["text"], F.lit(CONTROL)) | F.rlike(t["role"], F.lit(CONTROL)))
    tried = tried.withColumn("escaped", marked | (F.col("found") != F.col("turns")))
    final = tried.withColumn("parts", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    final = final.select("conv_id", "turns", "escaped", "parts", F.array_join("parts", "").alias("formatted"))
    return final.withColumn("parsed", parse(F.col("formatted"))).select(
        "conv_id", "parts", "formatted", "parsed", "escaped", (F.col("parsed") == F.col("turns")).alias("agrees")
    )


def with_loss_mask(formatted: DataFrame) -> DataFrame:
    """Adds ``loss_spans`` to what ``format_conversations`` gives."""
    return formatted.withColumn("loss_spans", loss_spans(F.col("parts")))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *,
    len(regexp_extract_all(text, '\[/?INST\]|</?s>')) + len(text) - len(replace(text, '\', '')) + len(regexp_extract_all(role, '\[/?INST\]|</?s>'))
      + len(role) - len(replace(role, '\', '')) + len(role) - len(replace(role, chr(10), '')) AS extra,
    regexp_matches(text, '(?s)\[/?INST\]|</?s>|\\.') OR regexp_matches(role, '(?s)\[/?INST\]|</?s>|\\|\n') AS conflict
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(len(role) + len(text) + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END) + CASE WHEN bool_or(conflict) THEN sum(extra) ELSE 0 END AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op10_chat", SQL)
def op10_chat(spark, sf_dir):
    own = spark.sql(
        "SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL "
        "SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_conversations(rows)
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return done.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
