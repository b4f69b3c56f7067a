"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the others as named
users and context roles (system) as they are; `mask` lists the parts of the rendered text to learn from: the speaker's
own words with their end mark. A part is `start-end` in code points, end exclusive.

Turns are numbered in ranges of the whole table and cut into blocks of `per_block` turns, whatever their own numbers are,
with a row per participant and block: no conversation is ever gathered whole, and no block is larger. Short ones are one
row. Joined in order of block, the rows are the dialogue. A row's mask counts from the start of its own text.

Defined cases: turns are put in order by number, then role, then text (null numbers
first; null roles are speakers named `unknown`); repeated rows are repeated turns; null texts are empty; conversations of
context roles alone, and rows without a conversation, have no participants and no rows; an empty table gives an empty
result; other columns are ignored. Marks inside texts are broken up (`<|` becomes `< |`), so texts can't end a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered

TURNS = 64
CONTEXT = ("system",)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_block: int = TURNS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """One row per conversation, participant and block: conv_id, speaker, block, n_turns, rendered, mask."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).where("conv_id is not null")
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "text"]
    rows, _ = numbered(rows, "conv_id", order[:4], order, ["conv_id", "role", "text"])
    rows = rows.withColumn("block", F.floor(F.col("pos") / per_block).cast("long"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))  # per_block at most
    speakers = rows.where(~F.col("role").isin(*context)).select("conv_id", F.col("role").alias("speaker")).distinct()
    # a speaker's row for each block, so that a long conversation is no one key
    last = rows.groupBy("conv_id").agg(F.max("block").alias("last"))
    seats = speakers.join(last, "conv_id").select("conv_id", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))

    def name(t):
        own, aside = t["role"] == F.col("speaker"), t["role"].isin(*context)
        return F.when(own, F.lit("assistant")).when(aside, t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))

    def piece(t):
        head = F.concat(F.lit("<|start|>"), name(t), F.lit("\n"))
        tail = F.concat(t["text"], F.lit("<|end|>\n"))
        return F.struct((t["role"] == F.col("speaker")).alias("own"), head.alias("head"), tail.alias("tail"))

    def add(acc, p):
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["tail"])
        part = F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"))

    pieces = blocks.join(seats, ["conv_id", "block"]).select("conv_id", "speaker", "block", F.transform("turns", piece).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return pieces.select(
        "conv_id",
        "speaker",
        "block",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"])), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", zero, add, lambda acc: acc["parts"]), ",").alias("mask"),
    )


ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role NOT IN ('system')),
p AS (
  SELECT r.conv_id, s.speaker, r.pos // {TURNS} AS block, r.pos, r.role, r.text, r.role = s.speaker AS own,
         '<|start|>' || CASE WHEN r.role = s.speaker THEN 'assistant' WHEN r.role IN ('system') THEN r.role
                             ELSE 'user name=' || r.role END || chr(10) AS head,
         r.text || '<|end|>' || chr(10) AS tail
  FROM r JOIN s ON r.conv_id = s.conv_id),
o AS (
  SELECT *, row_number() OVER w AS n,
         coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, speaker, block ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p WINDOW w AS (PARTITION BY conv_id, speaker, block ORDER BY pos))
SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(head || tail, '' ORDER BY n) AS rendered,
       coalesce(string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(tail) AS BIGINT), ',' ORDER BY n)
         FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, speaker, block
"""
