"""Queries over documents and benchmark items: what text came from where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import provenance as P
from tracewell.operators import report as R


#: Bytes a core below which a table of texts is dealt out: it may be one row
#: group, which a single task would read.
SPREAD_BYTES = 4 * 1024 * 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that is small for the cores is dealt to all of them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPREAD_BYTES:
        return table.repartition(cores)
    return table


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("seq"), "text")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("value_id"), "text")


def _hits(spark: SparkSession, sf_dir: str, owners: int | None = P.OWNERS) -> DataFrame:
    """Windows of benchmark items that documents hold, with the index capped.

    Only windows that an item has are indexed, so most rows go before a shuffle.
    """
    values = _values(spark, sf_dir)
    return P.contained(values, P.window_index(_sources(spark, sf_dir), owners, P.probe_rows(values)))


def taint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with text of a document, their windows found and their sources."""
    hits = _hits(spark, sf_dir, None)
    return hits.groupBy(F.col("value_id").alias("item_id")).agg(F.countDistinct("at").alias("n_windows"), F.countDistinct("source_id").alias("n_sources"))


def temporal_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of items that documents which came before them hold: an item comes
    after as many documents as four times its id."""
    values = _values(spark, sf_dir).withColumn("seq", F.col("value_id") * 4)
    sources = _sources(spark, sf_dir).withColumn("trusted", F.col("source_id") % 7 == 0)
    hits = P.contained(values, P.window_index(sources, None, P.probe_rows(values.drop("seq"))))
    return hits.groupBy(F.col("value_id").alias("item_id")).agg(F.countDistinct("at").alias("n_windows"), F.countDistinct("source_id").alias("n_sources"))


def shingle_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by their number of owners after the cap."""
    index = P.window_index(_sources(spark, sf_dir))
    return index.groupBy("window").agg(F.count("*").alias("owners")).groupBy("owners").agg(F.count("*").alias("n_windows"))


def atom_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity tokens and their first document."""
    return P.atom_index(_sources(spark, sf_dir)).select("atom", "source_id")


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of items that each document covers."""
    return P.merged_spans(_hits(spark, sf_dir), ["value_id", "source_id"])


def kinship_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share three windows or more."""
    return P.kinship_pairs(P.window_index(_sources(spark, sf_dir)))


def kinship_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected documents of :func:`kinship_pairs`."""
    return P.groups(kinship_pairs(spark, sf_dir))


def overlap_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stretch that two documents share in an item."""
    return P.overlaps(span_merge(spark, sf_dir))


def influence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest influences on each item."""
    return P.top_influences(P.influence(span_merge(spark, sf_dir)))


def footer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report under each item."""
    labelled = influence_topk(spark, sf_dir).withColumn("label", F.concat(F.lit("doc/"), F.col("source_id").cast("string")))
    return R.footer(labelled)


def window_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each item's first window, and its numbers read back."""
    normal = _values(spark, sf_dir).select("value_id", F.substring(T.normalize(F.col("text")), 1, T.WINDOW).alias("w")).filter(F.length("w") == T.WINDOW)
    keyed = normal.select("value_id", "w", T.window_key(F.col("w")).alias("key"))
    return keyed.select("value_id", F.get(T.parse_key(F.col("key")), F.lit(0)).alias("fnv"), F.get(T.parse_key(F.col("key")), F.lit(1)).alias("djb")).filter("fnv IS NOT NULL")


def window_keys_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every window of each item, and its numbers read back."""
    normal = _values(spark, sf_dir).select("value_id", T.normalize(F.col("text")).alias("t")).filter(F.length("t") >= T.WINDOW)
    placed = normal.select("value_id", "t", F.explode(F.sequence(F.lit(0), F.length("t") - T.WINDOW)).alias("at"))
    keyed = placed.select("value_id", "at", T.window_key(F.substring("t", F.col("at") + 1, F.lit(T.WINDOW))).alias("key"))
    return keyed.select("value_id", "at", F.get(T.parse_key(F.col("key")), F.lit(0)).alias("fnv"), F.get(T.parse_key(F.col("key")), F.lit(1)).alias("djb"))


_DECODE = ("plain", "a%20b", "a+b", "%2561", "100%", "%E9x", "x%2Fy+z%20w")


def decoded_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other spellings of fixed values."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(_DECODE)], "id long, v string")
    return rows.select("id", F.explode(T.decodings(F.col("v"))).alias("spelling"))


def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.sample(F.col("text")).alias("sample"))


def prose_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words between single spaces."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.prose_run(F.col("text")).cast("long").alias("run"))


_NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_INDEX = f"""d AS (SELECT doc_id AS source_id, {_NORMAL} AS t FROM documents),
w AS (SELECT DISTINCT source_id, substr(t, i::BIGINT + 1, 32) AS k FROM (SELECT source_id, t, unnest(range(0, length(t) - 31, 8)) AS i FROM d WHERE length(t) >= 32)),
x AS (SELECT k, source_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_id) AS n FROM w) WHERE n <= 4)"""
_HITS = f"""{_INDEX},
b AS (SELECT item_id AS value_id, {_NORMAL} AS t FROM benchmark),
q AS (SELECT value_id, i AS "at", substr(t, i::BIGINT + 1, 32) AS k FROM (SELECT value_id, t, unnest(range(0, length(t) - 31)) AS i FROM b WHERE length(t) >= 32)),
h AS (SELECT value_id, source_id, "at" FROM q JOIN x USING (k))"""
_SPANS = f"""{_HITS},
s AS (SELECT value_id, source_id, min("at") AS start, max("at") + 32 AS "end" FROM (
  SELECT *, sum(n) OVER (PARTITION BY value_id, source_id ORDER BY "at") AS g FROM (
  SELECT DISTINCT value_id, source_id, "at", CASE WHEN "at" <= lag("at") OVER (PARTITION BY value_id, source_id ORDER BY "at") + 32 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT * FROM h))) GROUP BY value_id, source_id, g)"""
_PAIRS = f"""{_INDEX},
p AS (SELECT a.source_id AS left_id, b.source_id AS right_id, count(*) AS shared FROM x a JOIN x b ON a.k = b.k AND a.source_id < b.source_id GROUP BY 1, 2 HAVING count(*) >= 3)"""
_TOP = f"""{_SPANS},
i AS (SELECT value_id, source_id, count(*) AS fragments, sum("end" - start)::BIGINT AS covered FROM s GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY value_id ORDER BY fragments DESC, source_id) AS rank, greatest(count(*) OVER (PARTITION BY value_id) - 10, 0) AS more FROM i),
top AS (SELECT * FROM t WHERE rank <= 10)"""

SQL = {
    "taint_check": f"""WITH {_HITS.replace(" WHERE n <= 4", "")} SELECT value_id AS item_id, count(DISTINCT "at") AS n_windows, count(DISTINCT source_id) AS n_sources FROM h GROUP BY 1""",
    "temporal_taint": f"""WITH {_HITS.replace(" WHERE n <= 4", "")} SELECT value_id AS item_id, count(DISTINCT "at") AS n_windows, count(DISTINCT source_id) AS n_sources
FROM h WHERE source_id < value_id * 4 AND source_id % 7 <> 0 GROUP BY 1""",
    "shingle_index_stats": f"WITH {_INDEX} SELECT owners, count(*) AS n_windows FROM (SELECT k, count(*) AS owners FROM x GROUP BY 1) GROUP BY 1",
    "atom_index": """
WITH a AS (SELECT doc_id, unnest(list_concat(
  list_transform(regexp_extract_all(text, '(?i)(?:https?://|mailto:)\\S+'), lambda v: regexp_replace(lower(v), '[.,;:!?)\\]]+$', '')),
  list_transform(regexp_extract_all(text, '(?i)\\b[\\w.-]+@[\\w-]+\\.[a-z]{2,}\\b'), lambda v: lower(v)),
  list_transform(regexp_extract_all(text, '(?:^|[^\\w/])([/~][\\w./-]{4,})', 1), lambda v: regexp_replace(lower(v), '[.,;:!?)\\]]+$', '')),
  list_filter(list_transform(regexp_extract_all(text, '(?i)\\b[a-z0-9][a-z0-9_-]{7,}\\b'), lambda v: lower(v)), lambda v: regexp_matches(v, '[0-9]')))) AS atom FROM documents)
SELECT atom, min(doc_id) AS source_id FROM a GROUP BY 1""",
    "span_merge": f'WITH {_SPANS} SELECT value_id, source_id, start, "end" FROM s',
    "kinship_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "kinship_groups": f"""WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM p UNION SELECT right_id, left_id FROM p),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS source_id, least(a, min(b)) AS group_id FROM r GROUP BY a""",
    "overlap_fragments": f"""WITH {_SPANS}, o AS (SELECT a.value_id, a.source_id AS left_id, b.source_id AS right_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
FROM s a JOIN s b ON a.value_id = b.value_id AND a.source_id < b.source_id)
SELECT value_id, left_id, right_id, min(start) AS start, arg_min("end", start) AS "end" FROM o WHERE "end" - start >= 32 GROUP BY 1, 2, 3""",
    "influence_topk": f"WITH {_TOP} SELECT value_id, source_id, fragments, covered, rank, more FROM top",
    "footer_text": f"""WITH {_TOP} SELECT value_id, chr(10) || 'Sources with passages in this answer:' || chr(10)
  || string_agg('  - "doc/' || source_id || '": passages word for word: ' || fragments, chr(10) ORDER BY rank)
  || CASE WHEN max(more) > 0 THEN chr(10) || '  - and ' || max(more) || ' further sources' ELSE '' END
  || chr(10) || 'Text put in other words is not detected, so a source without a mark may still have been used.' AS footer FROM top GROUP BY 1""",
    "window_keys": f"""WITH b AS (SELECT item_id AS value_id, substr({_NORMAL}, 1, 32) AS w FROM benchmark),
c AS (SELECT value_id, list_transform(string_split(w, ''), lambda x: unicode(x)::BIGINT) AS c FROM b WHERE length(w) = 32)
SELECT value_id, list_reduce(list_prepend(2166136261::BIGINT, c), lambda h, x: ((xor(h, x)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fnv,
  list_reduce(list_prepend(5381::BIGINT, c), lambda h, x: (h * 33 + x) % 4294967296) AS djb FROM c""",
    "decoded_probe": """SELECT * FROM (VALUES (1, 'a b'), (2, 'a b'), (3, '%61'), (3, 'a'), (6, 'x/y+z w'), (6, 'x%2Fy z%20w'), (6, 'x/y z w')) t(id, spelling)""",
    "sample_text": """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || chr(8230) ELSE t END AS sample FROM f""",
    "prose_run": """
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
k AS (SELECT *, regexp_matches(w, '^\\p{L}{2,}[,.!?;:)]?$') AS word, regexp_matches(w, '^(?:\\p{N}[\\p{N}.,]*|\\p{L})$') AS filler FROM t),
g AS (SELECT *, sum(CASE WHEN word OR filler THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM k)
SELECT doc_id, max(n)::BIGINT AS run FROM (SELECT doc_id, g, count(*) FILTER (word) AS n FROM g GROUP BY 1, 2) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "window_keys_whole")}
