"""A JSON-RPC gateway as tables: what a client's lines become on their way to a
server, and what its answers say to the session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import calls as K
from tracewell.operators import observe as O
from tracewell.operators import policy as G
from tracewell.sources import events as E


def _id_json(key: Column) -> Column:
    """A request's id as JSON from its type and value."""
    value = F.regexp_replace(key, "^[a-z]+:", "")
    text = F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.when(key.startswith("string:"), text).otherwise(value)


def inbound(lines: DataFrame, windows: DataFrame, tokens: DataFrame, declared: Mapping[str, Sequence[str]], allowed: Sequence[str], **limits) -> DataFrame:
    """(session_id, seq, receiver, line, decision, reason) for each line of a
    client (session_id, seq, line).

    A call that is allowed goes to the server as it came, a rewritten one with
    its arguments changed; a refused one is answered, as is a line that is no
    JSON.  Everything else passes.
    """
    parsed = E.parse_rpc(lines.select("session_id", "seq", "line"))
    body = F.try_parse_json("body")
    is_call = F.coalesce((F.col("type") == "request") & (F.col("method") == "tools/call"), F.lit(False))
    arguments = F.try_variant_get(body, "$.arguments", "variant")
    kind = F.split_part(F.schema_of_variant(arguments), F.lit("<"), F.lit(1))
    asked = parsed.filter(is_call).select(
        F.struct("session_id", "seq").alias("call_id"),
        F.try_variant_get(body, "$.name", "string").alias("tool"),
        F.when(arguments.isNull() | (kind == "VOID"), "{}").otherwise(F.to_json(arguments)).alias("args"),
    )
    judged = K.decided(asked, windows, tokens, declared, allowed, **limits).select("call_id", "decision", "reason", "args_out", "tool")
    met = parsed.withColumn("call_id", F.struct("session_id", "seq")).join(judged, "call_id", "left")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    changed = F.concat(F.lit('{"jsonrpc":"2.0","id":'), _id_json(F.col("id_key")), F.lit(',"method":"tools/call","params":{"name":'), quoted(F.col("tool")), F.lit(',"arguments":'), F.col("args_out"), F.lit("}}"))
    broken = F.try_parse_json("line").isNull()
    refused = F.coalesce(F.col("decision").isin("deny", "ask"), F.lit(False))
    return met.select(
        "session_id",
        "seq",
        F.when(refused | broken, "client").otherwise("server").alias("receiver"),
        F.when(broken, E.rpc_parse_error()).when(refused, E.rpc_error(_id_json(F.col("id_key")), F.col("reason"))).when(F.col("decision") == "rewrite", changed).otherwise(F.col("line")).alias("line"),
        "decision",
        "reason",
    )


def outbound(client: DataFrame, server: DataFrame, rendered_kinds: Sequence[str] = G.RENDERED_KINDS) -> DataFrame:
    """(session_id, seq, ord, kind, label, text, clean, substitute, unredacted)
    for each text of a server's answers; ``client`` and ``server`` are lines
    (session_id, seq, line) in one order of seq.

    A block that can't be read, or has no text, marks the session unredacted.
    """
    asked = E.parse_rpc(client.select("session_id", "seq", "line")).filter("type = 'request'")
    answered = E.parse_rpc(server.select("session_id", "seq", "line")).filter("type = 'response'")
    texts = O.rpc_texts(E.correlated(asked.unionByName(answered)))
    seen = texts.withColumns({"rendered": F.col("kind").isin(*rendered_kinds), "content": F.lit(True)})
    cleaned = O.observed(seen)
    return cleaned.select("session_id", "seq", "ord", "kind", "label", "text", "clean", F.coalesce("substitute", F.lit(False)).alias("substitute"), F.col("text").isNull().alias("unredacted"))
