"""Queries that run a stream over a whole table and return what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.provenance import checkpoint_dir
from tracewell.streaming import sessions


def _run(spark: SparkSession, sf_dir: str, name: str, made: Callable[[DataFrame], DataFrame], once: bool = True) -> DataFrame:
    """All rows of a table through ``made`` as one stream, to the shared folder.

    Timeouts by processing time always ask for another batch, so such a stream
    runs one; a stream with a watermark runs until nothing is left.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    root = f"{checkpoint_dir(table)}/stream-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/in")
    stream = made(spark.readStream.schema(table.schema).parquet(f"{root}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(**({"once": True} if once else {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and marks of conversations, from keyed state."""

    def events(rows: DataFrame) -> DataFrame:
        untrusted = F.col("role") != "user"
        made = rows.select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", untrusted.alias("untrusted"), F.concat_ws("/", "role", "conv_id", "turn").alias("label"), (untrusted & (F.length("text") % 3 == 0)).alias("uncleaned")
        )
        return sessions.stream_marks(made)

    return _run(spark, sf_dir, "conversations", events)


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that conversations' rows add up to, from keyed state."""

    def deltas(rows: DataFrame) -> DataFrame:
        made = rows.select(F.col("conv_id").alias("session_id"), F.lit("m").alias("message_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"), (F.col("turn") % 2 == 1).alias("final"))
        return sessions.stream_messages(made)

    return _run(spark, sf_dir, "conversations", deltas).select("session_id", F.md5("text").alias("digest"))


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of activity per user: gaps of two hours end one."""

    def activity(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
        return found.select("user_id", F.unix_timestamp("session_window.start").alias("start_s"), "n")

    return _run(spark, sf_dir, "events", activity, once=False)


SQL = {
    "stream_session": """WITH t AS (SELECT conv_id AS session_id, turn AS seq, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn,
  CASE WHEN role <> 'user' THEN role || '/' || conv_id || '/' || turn END AS label, role <> 'user' AND length(text) % 3 = 0 AS bad FROM conversations)
SELECT session_id, seq, turn::BIGINT AS turn, last_value(label IGNORE NULLS) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS exposure,
  last_value(label IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_source,
  coalesce(bool_or(bad) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS unredacted FROM t""",
    "stream_activity": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_messages": "WITH g AS (SELECT conv_id, turn // 2 AS m, string_agg(text, '' ORDER BY turn) AS t, max(turn) % 2 AS done FROM conversations GROUP BY 1, 2) SELECT conv_id AS session_id, md5(t) AS digest FROM g WHERE done = 1",
}
QUERIES = {name: globals()[name] for name in SQL}
