"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once more with that
speaker as the assistant and all others as users with their names; a mask marks what is to be
learned: the assistant's words, not the headers and not the others' turns.  A rendering is a row
for each turn; a perspective's segments in order of ``turn``, then ``tie``, give its text.  ``tie`` is a digest
of a turn's speaker and text, so that turns with equal numbers have one order in all perspectives
and in every run, and only turns that are the same in everything share a place.

The turns of a conversation are dealt in SALTS parts and its speakers go to each, so that a
conversation with a third of all turns stays spread over tasks.  Marks can't be forged: where a
text or a name has ``<|`` or ``|>``, a backslash is put between the two characters (and one more where
there are some already, so that it can be undone), and a line end in a name is a blank.

System turns keep their role, are never learned and take no perspective.  A null role is the
speaker ``unknown``, a null text is empty, and null conversations or turns are kept: a null
conversation is one conversation.  A repeated turn is rendered as often as it stands.  A
conversation of system turns alone has no participants and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
SALTS = 8


def escaped(text: Column) -> Column:
    """``text`` with a backslash more inside what could be read as a mark."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, tie, speaker, role, segment, mask_start, mask_end, learned_chars) for each perspective and turn.

    The half-open span mask_start to mask_end of the segment, in characters, is to be learned; it
    is empty for others' turns.  ``turns`` has conv_id, turn, role and text.
    """
    said = turns.select("conv_id", "turn", F.coalesce(F.trim("role"), F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("tie", F.md5(F.concat("speaker", F.lit("\n"), "text").cast("binary")))
    said = said.withColumn("salt", F.pmod(F.xxhash64("turn", "tie"), F.lit(SALTS)).cast("int"))
    # few speakers a conversation, but the join works for any number of them
    speakers = said.filter(F.lower("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    speakers = speakers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.lower("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = escaped(F.translate("speaker", "\r\n", "  "))
    header = F.when(F.col("role") == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    footer = "<|end|>\n"
    rendered = each.withColumn("role", role).withColumn("header", header).withColumn("shown", escaped(F.col("text")))
    learned = F.col("role") == "assistant"
    start = F.length("header")
    return rendered.select(
        "conv_id",
        "perspective",
        "turn",
        "tie",
        "speaker",
        "role",
        F.concat("header", "shown", F.lit(footer)).alias("segment"),
        start.alias("mask_start"),
        # the end mark is learned too: the model has to stop
        F.when(learned, start + F.length("shown") + F.lit(len(footer) - 1)).otherwise(start).alias("mask_end"),
        F.when(learned, F.length("shown")).otherwise(F.lit(0)).alias("learned_chars"),
    )


#: The same rows in DuckDB's SQL.
ORACLE = r"""
with said as (
  select conv_id, turn, coalesce(trim(role), 'unknown') as speaker, coalesce(text, '') as text from conversations
), speakers as (
  select distinct conv_id as of_conv, speaker as perspective from said where lower(speaker) <> 'system'
), each as (
  select conv_id, perspective, turn, speaker, md5(speaker || chr(10) || text) as tie,
    regexp_replace(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') as shown,
    regexp_replace(regexp_replace(translate(speaker, chr(13) || chr(10), '  '), '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') as name,
    case when lower(speaker) = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role
  from said join speakers on conv_id is not distinct from of_conv
), headed as (
  select *, case when role = 'user' then '<|user name=' || name || '|>' || chr(10) else '<|' || role || '|>' || chr(10) end as header from each
)
select conv_id, perspective, turn, tie, speaker, role,
  header || shown || '<|end|>' || chr(10) as segment,
  cast(length(header) as integer) as mask_start,
  cast(case when role = 'assistant' then length(header) + length(shown) + 7 else length(header) end as integer) as mask_end,
  cast(case when role = 'assistant' then length(shown) else 0 end as integer) as learned_chars
from headed
"""
