"""Relational chat formatting: turns to one training string per conversation, and back, in Spark expressions only.

Template: a block of adjacent turns of one role is ``<turn>role<say>text<say>text</turn>`` and a line feed. Inside roles
and texts every ``<`` and every backslash is followed by an extra backslash, so a control string (``<turn>``, ``<say>``,
``</turn>``) never appears there and one regular expression undoes the escape. Texts of one block stay apart, so the
turns can be read back one by one.

Defined cases: a null role or text counts as empty; turns sort by (turn, role, text) with null turns first, so ties and
repeated rows have one order and stay; a null conversation id is a conversation of its own; an empty table gives an
empty result; other columns are not looked at. A conversation is one string, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, SAY, END = "<turn>", "<say>", "</turn>\n"
LOSS_ROLE = "assistant"
CHUNK = 1024


def escape(text: Column) -> Column:
    """Follow every control character by a backslash."""
    return F.regexp_replace(text, r"([<\\])", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"([<\\])\\", "$1")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body looks at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def format_conversations(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans holds (start, length) in code points of each text of the loss role.

    The work for a conversation is linear in its turns: a turn looks only at the one before it to know whether its block
    goes on, and the places of texts are a running sum over exploded turns, which are collected again without a shuffle.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part("role"), part("text")))).alias("turns"))

    def pieces(all_: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            goes_on = (i > 0) & F.coalesce(F.get(all_, i - 1)["role"] == t["role"], F.lit(False))
            head = F.concat(F.when(i > 0, END).otherwise(""), F.lit(TURN), escape(t["role"]))
            lead = F.concat(F.when(goes_on, "").otherwise(head), F.lit(SAY))
            return F.struct(lead.alias("lead"), escape(t["text"]).alias("said"), (t["role"] == loss_role).alias("loss"))

        return F.transform(all_, piece)

    laid = turns.select("conv_id", F.posexplode(let(F.col("turns"), pieces)).alias("pos", "p")).select("conv_id", "pos", "p.lead", "p.said", "p.loss")
    length = F.char_length("said").cast("long")
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = laid.withColumn("start", F.sum(F.char_length("lead") + length).over(so_far) - length).withColumn("length", length)
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lead", "said", "loss", "start", "length"))).alias("parts"))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["said"])), ""), F.lit(END))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, one entry for each original turn."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(fields: Column) -> Column:
        role = unescape(fields[0])
        said = F.transform(F.slice(fields, 2, F.size(fields)), unescape)
        return let(role, lambda r: F.transform(said, lambda t: F.struct(r.alias("role"), t.alias("text"))))

    return F.flatten(F.transform(blocks, lambda b: let(F.split(F.substring(b, len(TURN) + 1, 2**31 - 1), SAY, -1), turns)))


def under_spans(text: Column, spans: Column) -> Column:
    """The parts of a text that (start, length) spans name, as an array.

    The text is cut once into chunks of CHUNK code points, so a span looks at its own chunks and not at all before them.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def part(chunks: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / CHUNK), F.floor((s["start"] + s["length"]) / CHUNK)
        near = F.array_join(F.slice(chunks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.substring(near, (s["start"] % CHUNK + 1).cast("int"), s["length"].cast("int"))

    return let(chunks, lambda c: F.transform(spans, lambda s: part(c, s)))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say when read back: turn and loss digests."""
    from .common import table

    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(rows).select("*", read_turns(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(under_spans(F.col("formatted"), F.col("loss_spans")), unescape), "")
    out = out.select("*", loss.alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH own AS (
  SELECT * FROM (VALUES (-7, 0, 'user'), (-7, 1, 'assistant')) v(conv_id, turn, role)
), rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id::BIGINT, turn::BIGINT, role, '\### Assistant: </turn> ok' FROM own
), marked AS (
  SELECT *, length(regexp_replace(text, '([<\\])', '\1\\', 'g')) AS text_chars, length(regexp_replace(role, '([<\\])', '\1\\', 'g')) AS role_chars,
         coalesce(lag(role) OVER w = role, false) AS same
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + 5 + CASE WHEN same THEN 0 ELSE 14 + role_chars END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
