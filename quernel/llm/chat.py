"""Chat formatting (operator 1, native): collapse of cumulative snapshots, then rendering.

A logger that stores a conversation again after every turn leaves conversations
that are prefixes of longer ones.  The hash of a prefix of k turns is the
exclusive or of hashes of (position, turn) over its turns, kept rolling by a
window over a conversation's turns; two seeds give 128 bits.  A conversation
whose whole hash is another's proper prefix goes by an anti-join, exact copies
become one, and only those that are left are rendered.

The window streams over hashes, not texts; texts are aggregated and rendered
for the conversations that are left alone, after a semi-join.  Prefixes and copies are aggregated before the
join, so a first turn that a third of all conversations share is one row in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What one turn of a rendered conversation looks like.
HEAD, FOOT = "<|{role}|>\n", "\n<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with two hashes of role and text; those without a conversation belong to none."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("a", F.xxhash64("role", "text"))
        .withColumn("b", F.xxhash64(F.lit(1), "text", "role"))
    )


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, n, p, q, whole: the hashes of each prefix of n turns, and whether that is all of it."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    same = lambda c: F.lag(c).over(order).eqNullSafe(F.col(c))
    turns = _turns(conversations).select("conv_id", "turn", "a", "b")
    # a turn that was stored twice counts once
    fresh = turns.withColumn("again", same("turn") & same("a") & same("b") & (F.row_number().over(order) > 1)).where("not again")
    placed = fresh.withColumn("n", F.row_number().over(order))
    rolling = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.select(
        "conv_id",
        "n",
        F.bit_xor(F.xxhash64("n", "a", "b")).over(rolling).alias("p"),
        F.bit_xor(F.xxhash64("b", "n", "a")).over(rolling).alias("q"),
        F.lead("n").over(order).isNull().alias("whole"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged: conversations that no other one extends; copies as their smallest conv_id."""
    prefixes = turn_prefixes(conversations)
    whole = prefixes.where("whole").groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    proper = prefixes.where("not whole").groupBy("n", "p", "q").agg(F.lit(True).alias("seen")).drop("seen")
    return whole.join(proper, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_logged")


def render(turns: Column, head: str = HEAD, foot: str = FOOT) -> Column:
    """The text of an array of structs with role and text."""
    before, after = head.split("{role}")
    one = lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(foot))
    return F.array_join(F.transform(turns, one), "")


def format_chats(conversations: DataFrame, head: str = HEAD, foot: str = FOOT) -> DataFrame:
    """conv_id, n_turns, n_logged, rendered for every maximal conversation.

    Turns go by their number, those without one first, equal numbers by the
    turns' hashes; a repeated row counts once.  A null role reads "unknown", a
    null text is empty, and rows with a null conv_id belong to no conversation.
    Other columns are ignored; an empty table gives an empty table.  A
    conversation is one row of the result, so its turns meet in one task.
    """
    kept = maximal_conversations(conversations)
    turns = _turns(conversations).join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "a", "b", "role", "text"))).alias("turns"))
    null_first = F.array_sort(
        "turns",
        lambda x, y: F.when(x["turn"].isNull() & y["turn"].isNotNull(), -1)
        .when(x["turn"].isNotNull() & y["turn"].isNull(), 1)
        .when(x["turn"] < y["turn"], -1)
        .when(x["turn"] > y["turn"], 1)
        .when(x["a"] < y["a"], -1)
        .when(x["a"] > y["a"], 1)
        .when(x["b"] < y["b"], -1)
        .when(x["b"] > y["b"], 1)
        .otherwise(0),
    )
    return kept.join(turns, "conv_id").select("conv_id", "n_turns", "n_logged", render(null_first, head, foot).alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS parts
  FROM t GROUP BY conv_id
), d AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged, parts FROM c GROUP BY n_turns, parts
), prefixes AS (
  SELECT DISTINCT parts[1:n] AS parts FROM (SELECT parts, unnest(range(1, n_turns)) AS n FROM d)
)
SELECT conv_id, n_turns, n_logged, array_to_string(parts, '') AS rendered
FROM d WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.parts = d.parts)
"""
