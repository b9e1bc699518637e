"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are then rendered.

A logger that stores a conversation after every turn leaves each conversation many times, as ever longer prefixes. Every
turn gets a rolling hash of its conversation up to there: two 64-bit hashes of (position, role, text), accumulated by
exclusive or over the turns so far. A conversation whose full hash is among the hashes of the proper prefixes of longer ones goes, by an
anti-join of the distinct full hashes with the distinct prefix hashes; of equal conversations the smallest conv_id stays.
Only DataFrame functions are used. Distinct hashes are formed before the shuffle, so a first turn that a third of the
conversations share is one row per task.

Turns are ordered by turn, then role and text; a null turn comes first, null roles and texts count as empty ones; rows with a null conv_id form one
conversation. Repeated rows are repeated turns. Texts of any length are hashed and rendered whole. Columns besides these four play no part, and are not
in the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import table, written

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of a widespread template


def numbered(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, role, text, its position k, the conversation's length n, prefix hashes (p1, p2) and full hashes (f1, f2)."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id")
    order = own.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = clean.withColumn("k", F.row_number().over(order))
    t = t.withColumns({"h1": F.xxhash64(F.lit(1), "k", "role", F.length("role"), "text"), "h2": F.xxhash64(F.lit(2), "text", F.length("text"), "role", "k")})
    return t.withColumns({
        "n": F.count(F.lit(1)).over(own), "p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto), "f1": F.bit_xor("h1").over(own), "f2": F.bit_xor("h2").over(own),
    }).drop("h1", "h2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """The turns of the maximal conversations, with position k, length n and logged (how many conversations are equal to it)."""
    t = written(numbered(turns))
    same = ["n", "f1", "f2"]
    full = t.where("k = 1").groupBy(*same).agg(F.min("conv_id").alias("keep"), F.count(F.lit(1)).alias("logged"))
    prefixes = t.where("k < n").select(F.col("k").cast("long").alias("n"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).distinct()
    longest = full.join(prefixes, same, "left_anti")
    kept = longest.select("keep", "logged")  # one row per conversation that stays; copies of it never meet
    return t.join(kept, F.col("conv_id").eqNullSafe(F.col("keep"))).select("conv_id", "k", "n", "role", "text", "logged")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, logged, rendered."""
    parts = F.sort_array(F.collect_list(F.struct("k", render(F.col("role"), F.col("text")).alias("part"))))
    return collapse(turns).groupBy("conv_id").agg(
        F.first("n").alias("n_turns"), F.first("logged").alias("logged"), F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("rendered")
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list('{START}' || role || chr(10) || text || '{END}' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS parts FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(parts[1:k], chr(31)) AS prefix FROM c, unnest(range(1, n)) AS r(k)),
s AS (SELECT array_to_string(parts, chr(31)) AS whole, min(conv_id) AS conv_id, count(*) AS logged, any_value(n) AS n_turns, any_value(parts) AS parts FROM c GROUP BY whole)
SELECT conv_id, n_turns, logged, array_to_string(parts, '') AS rendered FROM s WHERE whole NOT IN (SELECT prefix FROM p)"""
