"""Mixing sources to target weights by temperature.

Only DataFrame and SQL functions are used.

Token shares p of the sources are raised to an exponent a between 0 and 1 and
normalised to weights; a smaller exponent is flatter.  The exponent is found by
repeated section of its interval: the flattest that keeps every source within
``max_repetition`` passes, or the steepest whose weights still have an entropy
of ``target_entropy`` nats.  Without a budget the mixture is the smallest that
uses every document at least once, so nothing is lost.

A source's target is met by whole passes and one partial pass.  For the partial
pass the source's documents are dealt into blocks by hash and the blocks put in
hash order; blocks are taken up to the budget, and of the block that crosses
it, documents in hash order.  A block is small whatever the source's size, so
no source is ordered as a whole in one task, only its blocks.

Tokens of a document are its words and one for its end.

Defined results: a null text has no words; a null source is a source of its
own; every row counts, repeated ones too; rows that tie in id (or, without one,
in text) and tokens are taken together or not at all; a very long text is one
row, and one that passes the budget is not taken; an empty table gives an empty
table; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.workspace import Aside, Workspace, broadcast_if_small, read_documents

WORD = r"[^\x20\x09-\x0D]+"
#: Parts that each of four sections cuts the exponent's interval into.
SECTIONS, ROUNDS = 32, 4
BLOCK_ROWS = 1024
_SPACE = 1 << 32


def _order(id_col: Column, text: Column) -> Column:
    """A document's place in the hash order, as 32 hexadecimal digits: by its id,
    or by its text where it has none."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.md5(text), F.lit(""))))


def exponent(sources: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The exponent for ``sources`` (a column tokens); each section is one job
    over the sources that returns a row for each exponent tried."""
    low, high = 0.0, 1.0
    scaled = sources.select(F.col("tokens").cast("double").alias("t"))
    for _ in range(ROUNDS):
        tries = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        at = scaled.select("t", F.explode(F.array(*map(F.lit, tries))).alias("a"))
        if target_entropy is None:
            fits = at.groupBy("a").agg((F.pow(F.max("t") / F.min("t"), 1 - F.first("a")) <= F.lit(max_repetition)).alias("fits"))
        else:
            sums = at.groupBy("a").agg(F.sum(F.pow("t", "a")).alias("z"), F.sum(F.pow("t", "a") * F.log(F.pow("t", "a"))).alias("s"))
            fits = sums.select("a", (F.log("z") - F.col("s") / F.col("z") < F.lit(target_entropy)).alias("fits"))
        # fits turns from false to true as the exponent grows
        k = next((k for k, row in enumerate(sorted(fits.collect())) if row["fits"]), SECTIONS)
        low, high = tries[max(k - 1, 0)], tries[k]
    return low if target_entropy is not None and low > 0 else high


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repetition: float = 1.5,
    target_entropy: float | None = None,
    budget: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with n_tokens, weight, target_tokens (of the source) and copies."""
    work = Workspace(docs.sparkSession, "mixing")
    aside = Aside(docs, "n_tokens", "weight", "target_tokens", "copies")
    plain, id_col, text_col, source_col = aside.docs, *map(aside, (id_col, text_col, source_col))
    source = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    counted = plain.withColumns(
        {
            "n_tokens": (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) + 1).cast("long"),
            "_tw_source": source,
            "_tw_order": _order(F.col(id_col), F.col(text_col)),
        }
    )
    narrow = work.save(counted.select("_tw_source", "_tw_order", "n_tokens"), "tokens")
    sources = work.save(narrow.groupBy("_tw_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    total = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if total[0] is None:
        return counted.select(*aside.back, "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target_tokens"), F.lit(0).cast("long").alias("copies"))
    a = exponent(sources, max_repetition, target_entropy)
    powers = sources.withColumn("_tw_power", F.pow(F.col("tokens") / F.lit(float(total[1])), F.lit(a)))
    norm = powers.agg(F.sum("_tw_power")).first()[0]
    wanted = F.col("_tw_power") * F.lit(float(total[1])) if budget is None else F.col("_tw_power") * F.lit(budget / norm)
    passes = F.floor(F.col("target_tokens") / F.col("tokens"))
    planned = powers.select(
        "_tw_source",
        "tokens",
        (F.col("_tw_power") / F.lit(norm)).alias("weight"),
        # the largest source is used once exactly, however its power rounds
        F.greatest(F.floor(wanted), F.when(F.lit(budget is None), F.col("tokens")).otherwise(0)).cast("long").alias("target_tokens"),
        F.ceil(F.col("rows") / block_rows).cast("long").alias("_tw_blocks"),
    ).select("*", passes.cast("long").alias("_tw_passes"), (F.col("target_tokens") - passes * F.col("tokens")).cast("long").alias("_tw_rest"))
    planned = broadcast_if_small(work.save(planned.drop("tokens"), "planned"), "6", 16)
    block = F.floor(F.conv(F.substring("_tw_order", 1, 8), 16, 10).cast("long") * F.col("_tw_blocks") / F.lit(_SPACE)).cast("long")

    # blocks in order, each with the tokens before it
    sums = narrow.join(planned, "_tw_source").groupBy("_tw_source", block.alias("_tw_block")).agg(F.sum("n_tokens").alias("_tw_tokens"), F.first("_tw_rest").alias("_tw_rest"))
    place = F.md5(F.col("_tw_block").cast("string"))
    sums = work.save(sums.withColumns({"_tw_place": place, "_tw_part": F.substring(place, 1, 2)}), "sums")
    # running sums in two levels: the 256 parts of a source, then the blocks of a part
    parts = sums.groupBy("_tw_source", "_tw_part").agg(F.sum("_tw_tokens").alias("_tw_sum"))
    ahead = Window.partitionBy("_tw_source").orderBy("_tw_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_tw_source", "_tw_part", F.coalesce(F.sum("_tw_sum").over(ahead), F.lit(0)).alias("_tw_ahead"))
    within = Window.partitionBy("_tw_source", "_tw_part").orderBy("_tw_place", "_tw_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = sums.join(parts, ["_tw_source", "_tw_part"]).withColumn("_tw_past", F.col("_tw_ahead") + F.sum("_tw_tokens").over(within)).select(
        "_tw_source", "_tw_block", (F.col("_tw_past") <= F.col("_tw_rest")).alias("_tw_whole"), (F.col("_tw_past") - F.col("_tw_tokens")).alias("_tw_before"), "_tw_rest"
    )
    blocks = work.save(blocks.filter(F.col("_tw_before") < F.col("_tw_rest")), "blocks")
    crossing = broadcast_if_small(work.save(blocks.filter("NOT _tw_whole").drop("_tw_whole"), "crossing"), "4", 16)
    dealt = narrow.join(planned.select("_tw_source", "_tw_blocks"), "_tw_source").withColumn("_tw_block", block)
    # rows alike in id and tokens are taken together or not at all
    inside = Window.partitionBy("_tw_source", "_tw_block").orderBy("_tw_order", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the last document taken from each crossing block: a row for each source at most
    edge = (
        dealt.join(crossing, ["_tw_source", "_tw_block"])
        .withColumn("_tw_past", F.col("_tw_before") + F.sum("n_tokens").over(inside))
        .filter(F.col("_tw_past") <= F.col("_tw_rest"))
        .groupBy("_tw_source", "_tw_block")
        .agg(F.max(F.struct("_tw_order", "n_tokens")).alias("_tw_edge"))
    )
    taken = blocks.join(edge, ["_tw_source", "_tw_block"], "left").select("_tw_source", "_tw_block", "_tw_whole", "_tw_edge")
    taken = broadcast_if_small(work.save(taken, "taken"), "6", 16)
    marked = counted.join(planned, "_tw_source").withColumn("_tw_block", block).join(taken, ["_tw_source", "_tw_block"], "left")
    more = F.col("_tw_whole") | (F.struct("_tw_order", "n_tokens") <= F.col("_tw_edge"))
    copies = F.col("_tw_passes") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return marked.select(*aside.back, "n_tokens", "weight", "target_tokens", copies.cast("long").alias("copies"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mixture."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixture(docs).select("doc_id", "source", "n_tokens", "target_tokens", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mixture has it."""
    aside = Aside(docs)
    mixed = mixture(aside.docs, aside("doc_id"), aside("text"), aside("source"))
    repeated = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*aside.back)


def _section(k: int) -> str:
    """One section of the exponent's interval, in SQL."""
    return f"""e{k} AS (SELECT low + (high - low) * (greatest(n - 1, 0)) / 32 AS low, low + (high - low) * n / 32 AS high FROM
  (SELECT low, high, coalesce((SELECT min(i) FROM range(33) r(i) WHERE pow(top / least, 1 - (low + (high - low) * i / 32)) <= 1.5), 32) AS n FROM e{k - 1}, x))"""


SQL = {
    "op7_source_mixing": f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '')) + 1 AS n_tokens,
  md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS o FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY 1),
x AS (SELECT max(tokens)::DOUBLE AS top, min(tokens)::DOUBLE AS least FROM s),
e0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high),
{", ".join(_section(k) for k in (1, 2, 3, 4))},
p AS (SELECT source, tokens, greatest(floor(pow(tokens / top, high) * top), tokens)::BIGINT AS target_tokens, ceil(n / 1024)::BIGINT AS blocks FROM s, x, e4),
q AS (SELECT *, target_tokens // tokens AS passes, target_tokens % tokens AS rest FROM p),
b AS (SELECT d.*, target_tokens, passes, rest, floor(('0x' || substr(o, 1, 8))::BIGINT * blocks / 4294967296)::BIGINT AS block FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT source, block, sum(n_tokens) AS t FROM b GROUP BY 1, 2),
h AS (SELECT source, block, coalesce(sum(t) OVER (PARTITION BY source ORDER BY md5(block::VARCHAR), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
c AS (SELECT b.*, before + sum(n_tokens) OVER (PARTITION BY b.source, b.block ORDER BY o, n_tokens RANGE UNBOUNDED PRECEDING) AS past FROM b JOIN h ON b.block = h.block AND b.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, target_tokens, (passes + CASE WHEN past <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
}
