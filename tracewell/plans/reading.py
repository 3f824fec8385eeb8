"""Queries over what sessions read and what their values carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import observe as O
from tracewell.operators import provenance as P
from tracewell.plans.decisions import _EVENTS_SQL, _calls
from tracewell.plans.provenance import _NORMAL, _TOP, _sources, _table, _values
from tracewell.sources import events as E


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and label of what each call reads."""
    k = F.col("k")
    args = F.concat(F.lit('{"n": 1, "File-Path": "/d/'), k.cast("string"), F.lit('", "URL": "'), F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("https://h/"), k.cast("string"))), F.lit('"}'))
    flat = _calls(spark, sf_dir).withColumn("f", E.flatten_args(F.when(k % 5 == 0, F.lit("{}")).otherwise(args)))
    found = flat.select("event_id", O.source_kind(F.col("tool")).alias("kind"), O.source_label(F.col("f"), F.col("tool")).alias("label"), "tool")
    known = O.sources(found, ["https://h", "/d"], {"Read": "source"})
    return known.select("event_id", "kind", "label", "trusted", "rendered")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of sessions named by event types and users."""
    e = _table(spark, sf_dir, "events").select(F.concat_ws("/é ", "event_type", "user_id").alias("session")).distinct()
    return e.select("session", O.safe_name(F.col("session")).alias("name"))


def rpc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of responses by the method that was asked."""
    k = F.col("k").cast("string")
    method = F.element_at(F.array(*map(F.lit, ("tools/list", "tools/call", "resources/read", "prompts/get"))), (F.col("k") % 4 + 1).cast("int"))
    body = F.concat(
        F.lit('{"tools": [{"name": "t'), k, F.lit('", "description": "d"}, {"name": "u"}], "content": [{"type": "text", "text": "c"}, {"type": "image"}], "contents": [{"uri": "u:'), k,
        F.lit('", "text": "r"}], "messages": [{"content": {"type": "text", "text": "m"}}]}'),
    )
    return O.rpc_texts(_calls(spark, sf_dir).select("event_id", method.alias("asked"), body.alias("body"))).select("event_id", "ord", "kind", "label", "text")


def observed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages are substituted, and how many texts of each are recorded."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), (F.col("page_id") % 2 == 0).alias("rendered"), (F.col("page_id") % 7 != 0).alias("content"))
    return O.observed(pages).select("page_id", "substitute", F.size("recorded").cast("long").alias("recorded"))


def full_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, some percent-encoded, by how documents' text is found in them."""
    values = _values(spark, sf_dir)
    spelled = values.withColumn("text", F.when(F.col("value_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("%20"))).otherwise(F.col("text")))
    # what is indexed is bounded by the windows of the items in either spelling
    index = P.window_index(_sources(spark, sf_dir), P.OWNERS, P.probe_rows(values))
    return O.tainted(spelled, index, P.atom_index(_sources(spark, sf_dir))).groupBy("value_id", "via").agg(F.countDistinct("source_id").alias("n_sources"))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each source's session is full at 2,000 entries."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.regexp_replace("text", "[^a-z ]", " ").alias("text"))
    return O.saturation(docs, 2000)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and truncation of items as answers."""
    values = _values(spark, sf_dir)
    return O.attributed(values, P.window_index(_sources(spark, sf_dir), P.OWNERS, P.probe_rows(values)))


SQL = {
    "attribution": f"WITH {_TOP} SELECT value_id, source_id, fragments, covered, false AS truncated FROM i",
    "source_labels": f"""WITH {_EVENTS_SQL}, l AS (SELECT event_id, CASE tool WHEN 'WebFetch' THEN 'web' WHEN 'Bash' THEN 'bash' WHEN 'Read' THEN 'file' ELSE 'tool' END AS kind, tool,
  CASE WHEN k % 5 = 0 THEN tool WHEN k % 2 = 1 THEN 'https://h/' || k ELSE '/d/' || k END AS label FROM e)
SELECT event_id, kind, label, starts_with(label, 'https://h/') OR starts_with(label, '/d/') AS trusted, CASE WHEN tool = 'Read' THEN false ELSE kind = 'web' END AS rendered FROM l""",
    "safe_names": """SELECT DISTINCT event_type || '/é ' || user_id AS session, substr(regexp_replace(event_type || '/é ' || user_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64) || '-' || substr(sha256(event_type || '/é ' || user_id), 1, 16) AS name FROM events""",
    "rpc_texts": f"""WITH {_EVENTS_SQL} SELECT event_id, 0 AS ord, CASE WHEN k % 4 = 0 THEN 'mcp-description' ELSE 'tool' END AS kind, CASE k % 4 WHEN 0 THEN 't' || k WHEN 1 THEN 'tools/call' WHEN 2 THEN 'u:' || k ELSE 'prompts/get' END AS label,
  ['d', 'c', 'r', 'm'][k % 4 + 1] AS text FROM e UNION ALL SELECT event_id, 1, 'tool', 'tools/call', NULL FROM e WHERE k % 4 = 1""",
    "observed_pages": "SELECT page_id, page_id % 2 = 0 AS substitute, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS recorded FROM pages",
    "saturation": f"""WITH d AS (SELECT source, doc_id, regexp_replace(text, '[^a-z ]', ' ', 'g') AS text FROM documents), n AS (SELECT source, doc_id, {_NORMAL} AS t FROM d),
w AS (SELECT DISTINCT source, doc_id, substr(t, i::BIGINT + 1, 32) AS k FROM (SELECT source, doc_id, t, unnest(range(0, length(t) - 31, 8)) AS i FROM n WHERE length(t) >= 32)),
x AS (SELECT source, doc_id, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS r FROM w) WHERE r <= 4 GROUP BY 1, 2),
p AS (SELECT n.source, n.doc_id, sum(coalesce(c, 0)) OVER (PARTITION BY n.source ORDER BY n.doc_id) AS past FROM n LEFT JOIN x ON n.source = x.source AND n.doc_id = x.doc_id)
SELECT source AS session_id, doc_id AS seq, least(past, 2000)::BIGINT AS entries, past > 2000 AS saturated FROM p""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "full_taint")}
