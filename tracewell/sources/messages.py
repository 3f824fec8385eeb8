"""Messages of chat frameworks: content parts, message lists, tool results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.events import _Broken, _loaded

PART_DEPTH = 8
READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("unreadable", T.BooleanType())])


@F.arrow_udf(READ)
def read_content(contents: pa.Array) -> pa.Array:
    """(text, unreadable) of each content in JSON: a string, an object with a
    text, or a list of such, joined; anything else, or a list too deep, makes it
    unreadable, and what could be read stays."""

    def one(content: str | None) -> dict:
        node = _loaded(content) if content is not None else None
        if node is _Broken:
            return {"text": "", "unreadable": True}
        texts, unreadable, stack = [], False, [(node, 0)] if node is not None else []
        while stack:
            part, depth = stack.pop()
            if isinstance(part, str):
                texts.append(part)
            elif isinstance(part, list) and depth < PART_DEPTH:
                stack += [(x, depth + 1) for x in reversed(part)]
            elif isinstance(part, dict) and isinstance(part.get("text"), str):
                texts.append(part["text"])
            else:
                unreadable = True
        return {"text": "".join(texts), "unreadable": unreadable}

    return pa.array([one(c) for c in contents.to_pylist()], pa.struct([("text", pa.string()), ("unreadable", pa.bool_())]))


def message_text(content: Column) -> Column:
    """The text of a message's content in JSON: a string, or its text blocks one
    to a line; empty where there is none."""
    v = F.try_parse_json(content)
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    blocks = F.try_variant_get(v, "$", "array<variant>")
    typed = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").eqNullSafe(F.lit("text")))
    texts = F.filter(F.transform(typed, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    return F.coalesce(plain, F.array_join(texts, "\n"), F.lit(""))


def prompts(messages: DataFrame) -> DataFrame:
    """(session_id, step, idx, text, submit) from message lists (session_id,
    step, idx, role, content): the last human message of each step's list, and
    whether it is another than the step's before."""
    said = messages.filter("role IN ('human', 'user')")
    last = said.groupBy("session_id", "step").agg(F.max(F.struct("idx", "content")).alias("m"))
    read = last.select("session_id", "step", "m.idx", message_text(F.col("m.content")).alias("text"))
    order = Window.partitionBy("session_id").orderBy("step")
    same = F.lag("idx").over(order).eqNullSafe(F.col("idx")) & F.lag("text").over(order).eqNullSafe(F.col("text"))
    return read.withColumn("submit", ~same)


def refusals(decisions: DataFrame) -> DataFrame:
    """The messages (call_id, role, status, content) that a framework gets in
    place of the results of calls that are denied or would have to be asked for
    (decision, reason)."""
    stopped = decisions.filter("decision IN ('deny', 'ask')")
    return stopped.select("call_id", F.lit("tool").alias("role"), F.lit("error").alias("status"), F.col("reason").alias("content"))


#: What becomes of a result that has text no reader would see, by transport: a
#: hook replaces the text in place, a second harness gets a refusal with the
#: clean text, blocks of a protocol or a framework are built anew.
TRANSPORTS = {"hook": "substitute", "harness": "reject", "protocol": "rebuild", "framework": "rebuild"}


def substitution(transport: Column, substitute: Column, readable: Column) -> Column:
    """What is handed on: pass, substitute, reject or rebuild; ``mark`` where a
    shape is unknown, so that the session counts as unredacted."""
    rule = F.try_element_at(F.create_map(*[F.lit(x) for pair in TRANSPORTS.items() for x in pair]), transport)
    return F.when(~readable, "mark").when(substitute, F.coalesce(rule, F.lit("mark"))).otherwise("pass")
