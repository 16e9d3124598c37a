"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions alone.

A log that stores a conversation anew after every turn holds each early state
as a conversation of its own.  Every turn gets the hash of all turns up to it;
a conversation whose full hash is the hash of a shorter part of another one
prefixes that one and goes, and of equal conversations the one with the
smallest conv_id stays.  What is left is rendered.

The hash of a prefix is a sum over its turns of hashes of (position, role,
text), in three lanes of 40 bits: as the position is hashed with the turn, the
sum fixes the order, and sums can be taken over any split of a long
conversation.  Hashes that occur many times (a first turn that a third of all
conversations share) are made distinct before the anti-join.

Rendered turns are joined into one row for each SEGMENT turns of a
conversation, so that no row gathers an unbounded group; a conversation of up
to SEGMENT turns is one row.

Defined results for odd input: turns stand in the order of (turn, role, text),
nulls first, so ties and repeated rows have a place; a null role counts as
"unknown" and a null text as empty; rows of null conv_id are one
conversation, which stays only if no other equals it.  "<|" within a text is
written "<\\u200b|", so that no text can close its own turn.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Rows, written

SEGMENT = 256
LANES = 3
BITS = (1 << 40) - 1


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All turns as rows (conv_id, turn, role, text, pos, h0.., part), and the conv_id, n_turns of the conversations that stay."""
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = Rows(own, ["conv_id"], ["turn", "role", "text"])
    placed = rows.running(rows.rows, pos=F.lit(1).cast("long"))
    lanes = {f"h{k}": F.xxhash64(F.lit(k), "pos", "role", "text").bitwiseAND(F.lit(BITS)) for k in range(LANES)}
    hashed = rows.running(placed, **lanes)
    slim = written(hashed.select("conv_id", "pos", *lanes))
    last = slim.groupBy("conv_id").agg(F.max(F.struct("pos", *lanes)).alias("e")).select("conv_id", "e.*")
    whole = last.groupBy("pos", *lanes).agg(F.min("conv_id").alias("conv_id"))
    ends = last.select(F.col("conv_id").alias("c"), F.col("pos").alias("end"))
    # states that some longer conversation passed through
    passed = slim.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < end").select("pos", *lanes).distinct()
    kept = whole.join(passed, ["pos", *lanes], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))
    return placed, kept


def render(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns (of the conversation), n_chars, text for every conversation that stays."""
    placed, kept = maximal(turns)
    kept = written(kept).withColumnRenamed("conv_id", "kept_id")
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.replace(F.col("text"), F.lit("<|"), F.lit("<​|")), F.lit("<|im_end|>\n"))
    rows = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "n_turns", F.floor((F.col("pos") - 1) / SEGMENT).alias("segment"), "pos", line.alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    out = rows.groupBy("conv_id", "segment", "n_turns").agg(text.alias("text"))
    return out.select("conv_id", "segment", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")


ORACLE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
p AS (SELECT *, string_agg(sha256(pos || '/' || role || '/' || text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS state, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
ends AS (SELECT state, min(conv_id) AS conv_id, any_value(n) AS n FROM p WHERE pos = n GROUP BY state),
kept AS (SELECT * FROM ends WHERE state NOT IN (SELECT state FROM p WHERE pos < n))
SELECT t.conv_id, CAST((t.pos - 1) // 256 AS BIGINT) AS segment, CAST(k.n AS BIGINT) AS n_turns, CAST(sum(length('<|im_start|>' || role || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10))) AS BIGINT) AS n_chars,
  string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS text
FROM t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""
