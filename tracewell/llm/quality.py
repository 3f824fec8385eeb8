"""Quality rules: word and line measures, and cross-document line frequency.

Only DataFrame and SQL functions are used.

A line is normalised (ASCII letters lowered, runs of white space one space,
ends stripped, digits 0) and hashed with its host.  A line found in more than
``line_limit`` documents of one host is boilerplate there: it is removed from
every one of them but the document of smallest id, which keeps it, so no text
is lost altogether.  A document with less than ``min_kept_pct`` percent of its
words left is depleted and rejected, as is one that fails the base rules.

Defined results: a null text is an empty one; a null host is a host of its
own; every row is a document, so repeated rows count each; rows with a null id
rank after all others, and if all rows of a line have a null id all keep it;
rows alike in id and text get the same verdict; texts are measured whole, a very
long one as one row; columns named like a result are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.workspace import Aside, Workspace, broadcast_if_small, read_documents

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    """A line as it is compared across documents."""
    lower = F.translate(line, string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9)
    return F.trim(F.regexp_replace(lower, SPACE, " "))


def line_key(host: Column, line: Column) -> Column:
    """The 64-bit hash of a host and a normalised line."""
    return F.xxhash64(F.coalesce(host, F.lit("")), host.isNull(), normal_line(line))


def row_key(id_col: Column, text: Column) -> Column:
    """A key that rows share only if their id and text are the same."""
    return F.xxhash64(id_col, text)


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (all long), each over the whole text."""
    aside = Aside(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text, own = F.coalesce(F.col(aside(text_col)), F.lit("")), aside.own
    split = aside.docs.select(*own, F.array_remove(F.split(text, SPACE, -1), "").alias("_tw_words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("_tw_lines"))
    hashed = split.withColumn(
        "_tw_grams",
        F.transform(
            F.slice("_tw_words", F.lit(1), F.greatest(F.size("_tw_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_tw_words", i + 1), F.get("_tw_words", i + 2)),
        ),
    )
    # equal windows lie side by side once sorted by hash; only texts with a repeat are sorted
    ranked = hashed.withColumn(
        "_tw_sorted",
        F.when(
            F.size(F.array_distinct("_tw_grams")) < F.size("_tw_grams"),
            F.sort_array(F.transform("_tw_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeats = ranked.withColumn(
        "_tw_at",
        F.sort_array(
            F.transform(
                F.filter(
                    "_tw_sorted",
                    lambda x, k: x["h"].eqNullSafe(F.get("_tw_sorted", k + 1)["h"]) | x["h"].eqNullSafe(F.get("_tw_sorted", k - 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    # each repeated window adds the words that the next one does not start with
    covered = F.aggregate(
        F.transform("_tw_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_tw_at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    measures = F.struct(
        F.size("_tw_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_tw_lines") - F.size(F.array_distinct("_tw_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # a generator of one row: filters on the measures stay above it, so that
    # the optimizer doesn't copy their expressions into each other
    return repeats.select(*own, F.inline(F.array(measures))).select(*aside.back, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each line with a word: its key, its words, and whether it is
    the first of its key in its row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("_tw_id"),
        row_key(F.col(id_col), F.col(text_col)).alias("_tw_row"),
        F.sort_array(
            F.transform(
                F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
                lambda x: F.struct(line_key(F.col(host_col), x).alias("k"), F.regexp_count(x, F.lit(WORD)).alias("w")),
            )
        ).alias("_tw_lines"),
    )
    return lines.select(
        "_tw_id",
        "_tw_row",
        F.inline(
            F.transform(
                "_tw_lines",
                lambda x, i: F.struct(
                    x["k"].alias("_tw_key"),
                    x["w"].cast("long").alias("_tw_n"),
                    F.when((i > 0) & (F.get("_tw_lines", i - 1)["k"] == x["k"]), 0).otherwise(1).alias("_tw_first"),
                ),
            )
        ),
    )


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_limit: int, work: Workspace) -> DataFrame:
    """For each row that loses lines: the keys of those lines and their words.

    Lines are hashed once; both reads are of the saved hashes.
    """
    lines = work.save(line_rows(docs, id_col, text_col, host_col), "lines")
    limits = (
        lines.groupBy("_tw_key")
        .agg(F.sum("_tw_first").alias("_tw_docs"), F.min("_tw_id").alias("_tw_keeper"))
        .filter(F.col("_tw_docs") > line_limit)
        .select("_tw_key", "_tw_keeper")
    )
    lost = lines.join(limits, "_tw_key").filter(~F.col("_tw_id").eqNullSafe(F.col("_tw_keeper")))
    # rows that are alike in id and text share a key: their words count once
    return (
        lost.groupBy("_tw_row", "_tw_key")
        .agg((F.sum("_tw_n") / F.sum("_tw_first")).cast("long").alias("_tw_n"))
        .groupBy("_tw_row")
        .agg(F.sum("_tw_n").alias("_tw_lost"), F.collect_list("_tw_key").alias("_tw_keys"))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    line_limit: int = 10,
    min_kept_pct: int = 30,
) -> DataFrame:
    """``docs`` with the base measures, n_kept_words, base_failed, kept and
    clean_text (the text without its frequent lines).

    Columns of ``docs`` by one of these names are replaced.
    """
    work = Workspace(docs.sparkSession, "quality")
    added = ("n_kept_words", "base_failed", "kept", "clean_text")
    aside = Aside(docs, *added, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    id_col, text_col, host_col = map(aside, (id_col, text_col, host_col))
    lost = work.save(frequent_lines(aside.docs, id_col, text_col, host_col, line_limit, work), "lost")
    work.drop("lines")
    measured = base_measures(aside.docs, text_col)
    joined = measured.withColumn("_tw_row", row_key(F.col(id_col), F.col(text_col))).join(
        broadcast_if_small(lost, "size(_tw_keys) + 6", 8), "_tw_row", "left"
    )
    kept_words = F.col("n_words") - F.coalesce(F.col("_tw_lost"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    clean = F.when(F.col("_tw_keys").isNull(), F.col(text_col)).otherwise(
        F.array_join(
            F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains("_tw_keys", line_key(F.col(host_col), x))),
            "\n",
        )
    )
    return joined.select(
        *aside.back,
        *measured.columns[len(aside.own) :],
        kept_words.alias("n_kept_words"),
        failed.alias("base_failed"),
        (~failed & (100 * kept_words >= min_kept_pct * F.col("n_words"))).alias("kept"),
        clean.alias("clean_text"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    docs = read_documents(spark, sf_dir)
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, the others lose their frequent lines."""
    aside = Aside(docs)
    judged = quality_rules(aside.docs, aside("doc_id"), aside("text"), aside("source")).filter("kept")
    return judged.withColumn(aside("text"), F.col("clean_text")).select(*aside.back)


SQL = {
    "op1_quality_rules": """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, source, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws,
  list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
a AS (SELECT doc_id, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, v || ' ' || lead(v) OVER d || ' ' || lead(v, 2) OVER d AS k FROM a WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g WHERE k IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, source, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k,
  len(list_filter(regexp_split_to_array(s, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')) AS n FROM (SELECT doc_id, source, unnest(ls) AS s FROM w)),
f AS (SELECT source, k, min(doc_id) AS keeper FROM l GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
b AS (SELECT l.doc_id, sum(l.n) AS lost FROM l JOIN f ON l.k = f.k AND l.source IS NOT DISTINCT FROM f.source WHERE l.doc_id <> f.keeper GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
  length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) - coalesce(lost, 0) AS n_kept_words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_kept_words::BIGINT AS n_kept_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 30 * n_words AS kept
FROM m
"""
}
