"""Chat formatting by perspective rotation.

A conversation is rendered once for each of its participants.  In a rendering
that participant is the assistant and everyone else is a user under their own
name; the mask covers what the assistant says, its end mark included, and
nothing else:

    <|user:NAME|>\\ntext<|end|>\\n<|assistant|>\\ntext<|end|>\\n

Participants are the distinct roles.  All is one shuffle by conversation and
built-in functions; a conversation is the unit and is held in one row.  Where a
turn begins is a running sum over the conversation, in which a speaker's own
turns differ from the others' by a constant, so work is linear in the turns of a
rendering.

Markers cannot be forged: within texts `<|` becomes `<\\|`, and within names `%`,
`|`, `<` and `>` become `%25`, `%7C`, `%3C` and `%3E`, so every `<|` of a
rendering is a marker and different roles have different names. `plain_text` and
`plain_name` give what was said and by whom.

Defined cases: turns of null conv_id, null role or null text are left out; a
null turn comes before all others. Turns of one number are ordered by role,
then text; repeated rows are said once. A text's own `<\\` before bars is kept
apart by one more backslash. Empty text is an empty turn. Extra columns are
ignored. No rows give no rows. Conversation ids may be of any type that can be
grouped by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "<|assistant|>\n"
END = "<|end|>\n"
NAME = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def name(role: Column) -> Column:
    """A role as it stands in a marker."""
    return _replaced(role, NAME)


def plain_name(shown: str) -> str:
    for a, b in reversed(NAME):
        shown = shown.replace(b, a)
    return shown


def quoted(text: Column) -> Column:
    """A text without a marker's beginning: one more backslash between `<` and `|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def plain_text(shown: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", shown)


def user(role: Column) -> Column:
    """The marker before what another says."""
    return F.concat(F.lit("<|user:"), name(role), F.lit("|>\n"))


def rotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, rendered, mask): mask holds [begin, end) of the assistant's characters in rendered."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = [F.col(c).eqNullSafe(F.lag(c).over(in_order)) for c in ("turn", "role", "text")]
    said = F.struct("at", "role", "head", "shown")
    turns = (
        conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text")
        .where("conv_id is not null and role is not null and text is not null")
        .withColumn("again", again[0] & again[1] & again[2]).withColumns({"head": user(F.col("role")), "shown": F.concat(quoted(F.col("text")), F.lit(END))})
        .withColumn("size", F.when(F.col("again"), 0).otherwise(F.length("head") + F.length("shown")))
        .withColumn("at", F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("not again").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    )
    each = turns.withColumn("speaker", F.explode(F.array_sort(F.array_distinct(F.col("said.role")))))
    speaker = F.col("speaker")
    shift = F.length(F.lit(ASSISTANT)) - F.length(user(speaker))

    def span(t: Column, k: Column) -> Column:
        begin = t["at"] + shift * k + len(ASSISTANT)
        return F.array(begin.cast("int"), (begin + F.length(t["shown"])).cast("int"))

    return each.select(
        "conv_id",
        "speaker",
        F.size("said").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: F.concat(F.when(t["role"] == speaker, F.lit(ASSISTANT)).otherwise(t["head"]), t["shown"])), "").alias("rendered"),
        F.transform(F.filter("said", lambda t: t["role"] == speaker), span).alias("mask"),
    )


#: The mask is compared as text, as nested lists hash differently between engines.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
           WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
x AS (SELECT t.conv_id, p.speaker, t.turn, t.role, t.text,
             CASE WHEN t.role = p.speaker THEN '<|assistant|>' || chr(10)
                  ELSE '<|user:' || replace(replace(replace(replace(t.role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E') || '|>' || chr(10) END AS head
      FROM t JOIN p ON t.conv_id = p.conv_id),
y AS (SELECT *, head || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS piece FROM x),
z AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM y)
SELECT conv_id, speaker, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       string_agg(CASE WHEN role = speaker THEN CAST(pos + length(head) AS VARCHAR) || '-' || CAST(pos + length(piece) AS VARCHAR) END,
                  ',' ORDER BY turn NULLS FIRST, role, text) AS mask
FROM z GROUP BY conv_id, speaker
"""
