"""Preference formatting: one prompt, two masked completions.

Only DataFrame and SQL functions are used.

A pair has a chosen and a rejected conversation.  Their longest common prefix
of turns (same turn, role and text) is rendered once as the prompt.  What
follows on either side is a completion, and its mask lists the stretches that
are trained on: what the assistant says there, to the end of its turn.

A turn is rendered as ``<|role|>``, a line end, its text and a line end.  A pair
is one row, however long its conversations are; they are sorted and summed
while they are rows, so the work grows with their length and no faster.

Defined results: a null text is empty and a null role is ``unknown``; rows
without a conversation or turn belong to none; different rows for the same turn
of a conversation all count, in order of role and text, and rows alike are one;
a pair with one side only gives no row; other columns are not read; an empty
table gives an empty table.  A very long text is rendered whole: a pair is limited by
what one value of a table can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a rendered turn besides its role and text.
_AROUND = len("<||>\n\n")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """``start-end`` of each trained stretch, end exclusive, joined by commas."""
    begin = F.get(turns, F.lit(0))
    base = begin["past"] - F.length(begin["role"]) - F.length(begin["text"]) - _AROUND
    span = lambda t: F.concat_ws("-", (t["past"] - base - F.length(t["text"]) - 1).cast("string"), (t["past"] - base).cast("string"))
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), span), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Rows for training from ``turns``: pair_id, rejected (boolean), turn, role, text."""
    said = [F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    real = turns.filter("pair_id IS NOT NULL AND turn IS NOT NULL AND rejected IS NOT NULL").select("pair_id", "rejected", "turn", *said)
    ordered = Window.partitionBy("pair_id", "rejected").orderBy("turn", "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(ordered).eqNullSafe(F.struct("turn", "role", "text"))
    size = (F.length("role") + F.length("text") + _AROUND).cast("long")
    # one shuffle: windows and groups of a pair lie in one partition
    different = real.repartition("pair_id").withColumn("same", same).filter("NOT same")
    placed = different.withColumn("past", F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.struct("turn", "role", "text", "past")
    sides = placed.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(of, turn))).alias(side) for side, of in (("c", ~F.col("rejected")), ("r", F.col("rejected")))]
    )
    # the sums before agree as long as the turns do
    differ = F.array_position(F.zip_with("c", "r", lambda c, r: ~c.eqNullSafe(r)), True)
    both = sides.filter("size(c) > 0 AND size(r) > 0").select(
        "pair_id", "c", "r", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int").alias("n")
    )
    rest = {side: F.slice(side, F.col("n") + 1, F.size(side)) for side in "cr"}
    cut = both.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), *[v.alias(k) for k, v in rest.items()])
    return cut.select(
        "pair_id",
        "n_prompt_turns",
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in pairs of an even id, chosen, and the odd id after it."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = talk.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")
    return preference_pairs(turns)


def _side(name: str, odd: int) -> str:
    """Completion and mask of one side, in SQL."""
    return f"""{name} AS (SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) AS body,
  string_agg((past - length(text) - 1)::BIGINT || '-' || past::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS mask
  FROM (SELECT *, sum(length(role) + length(text) + 6) OVER (PARTITION BY pair_id ORDER BY i) AS past FROM (
  SELECT t.* FROM t JOIN cut USING (pair_id) WHERE odd = {odd} AND i >= coalesce(cut.cut, i + 1))) GROUP BY 1)"""


SQL = {
    "op9_preference_formatting": f"""
WITH s AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS odd, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, odd ORDER BY turn, role, text) AS i FROM s),
two AS (SELECT pair_id FROM t GROUP BY 1 HAVING count(DISTINCT odd) = 2),
same AS (SELECT a.pair_id, a.i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.odd = 0 AND b.odd = 1 AND a.turn = b.turn AND a.role = b.role AND a.text = b.text),
cut AS (SELECT pair_id, min(i) FILTER (NOT EXISTS (SELECT 1 FROM same WHERE same.pair_id = t.pair_id AND same.i = t.i)) AS cut FROM t WHERE pair_id IN (SELECT pair_id FROM two) GROUP BY 1),
{_side("c", 0)},
{_side("r", 1)},
p AS (SELECT t.pair_id, count(*) AS n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) AS body
  FROM t JOIN cut USING (pair_id) WHERE odd = 0 AND i < coalesce(cut.cut, i + 1) GROUP BY 1)
SELECT pair_id, coalesce(p.n, 0)::BIGINT AS n_prompt_turns, coalesce(p.body, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM two LEFT JOIN p USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN r USING (pair_id)
"""
}
