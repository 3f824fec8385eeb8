"""Events of agent harnesses, JSON-RPC lines, and what is written back.

Lines are parsed to VARIANT once; a row that doesn't parse becomes an event of
kind ``unparsable`` and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FIELDS, MAX_DEPTH = 2000, 8
#: Keys of a response that hold text, labels, or nothing to read; limits of the walk.
TEXT_KEYS = (
    "text", "stdout", "stderr", "content", "result", "output", "message", "description", "body", "error",
)
LABEL_KEYS = (
    "title", "label", "name", "query", "command", "activeform", "data", "code",
)
OPAQUE_KEYS = (
    "type", "subtype", "kind", "role", "mode", "status", "state", "uri", "url", "urls", "href", "link", "links", "host", "hostname", "filepath",
    "filepaths", "path", "paths", "file", "files", "filename", "filenames", "toolname", "tool", "id", "uuid", "sessionid", "requestid", "mimetype",
    "mediatype", "encoding", "language", "lang", "format", "extension", "ext", "sha", "hash", "key", "errorcode", "codetext", "cwd", "model",
    "version", "timestamp", "date", "oldstring", "newstring",
)
TEXTLESS = frozenset(("Write", "Edit", "NotebookEdit", "TodoWrite"))
WALK_DEPTH, WALK_NODES, WALK_CHARS, TOKEN_CHARS = 12, 20_000, 8_000_000, 64


def _text(v: Column, path: str) -> Column:
    """A string member; null if it is absent or of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _kind(v: Column, path: str = "$") -> Column:
    """STRING, OBJECT, ARRAY, VOID, ...; null if absent."""
    return F.split_part(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("<"), F.lit(1))


def read_texts(spark, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_events(lines: DataFrame, dialect: str = "a") -> DataFrame:
    """``lines`` (column line) with kind, session_id, text, tool, args, response,
    message_id, final, server (whose tool is called, if a server's) and reason.

    Dialect ``a`` names prompts, calls, results and displayed messages one way,
    ``b`` another; kinds are prompt, call, result, display, answer, ignored and
    unparsable.
    """
    v = F.try_parse_json("line")
    name = _text(v, "$.hook_event_name")
    names = {
        "a": {"UserPromptSubmit": "prompt", "PreToolUse": "call", "PostToolUse": "result", "MessageDisplay": "display"},
        "b": {"BeforeAgent": "prompt", "BeforeTool": "call", "AfterTool": "result", "AfterAgent": "answer"},
    }[dialect]
    meant = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)
    tool, input_kind = F.coalesce(_text(v, "$.tool_name"), F.lit("")), _kind(v, "$.tool_input")
    allowed = F.coalesce(input_kind, F.lit("OBJECT")).isin("OBJECT", *(["VOID"] if dialect == "b" else []))
    reason = (
        F.when(v.isNull(), "the line is no JSON")
        .when(_kind(v) != "OBJECT", "the line holds no object")
        .when((meant == "display") & (F.coalesce(_text(v, "$.message_id"), F.lit("")) == ""), "no message_id")
        .when((meant == "display") & _text(v, "$.delta").isNull(), "delta is no string")
        .when(F.lit(dialect == "b") & meant.isin("call", "result") & (tool == ""), "no tool_name")
        .when((meant == "call") & ~allowed, F.concat(F.lit("tool_input is no object in a call of "), tool))
    )
    session = _text(v, "$.session_id")
    text = F.when(meant == "prompt", F.coalesce(_text(v, "$.prompt"), F.lit(""))).when(meant == "display", _text(v, "$.delta")).when(meant == "answer", F.coalesce(_text(v, "$.response"), F.lit("")))
    acts = meant.isin("call", "result")
    return lines.select(
        "*",
        F.when(reason.isNotNull(), "unparsable").otherwise(F.coalesce(meant, F.lit("ignored"))).alias("kind"),
        F.when((_kind(v) == "OBJECT") & (session != ""), session).otherwise("default").alias("session_id"),
        F.when(reason.isNull(), text).alias("text"),
        F.when(reason.isNull() & acts, tool).alias("tool"),
        F.when(reason.isNull() & acts, F.when(input_kind == "OBJECT", F.to_json(F.try_variant_get(v, "$.tool_input", "variant"))).otherwise("{}")).alias("args"),
        F.when(reason.isNull() & (meant == "result"), F.to_json(F.try_variant_get(v, "$.tool_response", "variant"))).alias("response"),
        F.when(reason.isNull() & (meant == "display"), _text(v, "$.message_id")).alias("message_id"),
        F.coalesce(F.try_variant_get(v, "$.final", "boolean"), F.lit(False)).alias("final"),
        F.when(reason.isNull() & acts & F.lit(dialect == "b"), _text(v, "$.mcp_context.server_name")).alias("server"),
        reason.alias("reason"),
    )


def parse_rpc(lines: DataFrame) -> DataFrame:
    """``lines`` (column line) with type (request, notification, response, or
    null for what is none), id_key (type and value), method and body."""
    v = F.try_parse_json("line")
    id_kind = _kind(v, "$.id")
    number = F.coalesce(id_kind.rlike("^(BIGINT|INT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    key = F.when(id_kind == "STRING", F.concat(F.lit("string:"), F.try_variant_get(v, "$.id", "string"))).when(number, F.concat(F.lit("number:"), F.try_variant_get(v, "$.id", "string"))).when(id_kind == "VOID", "object:null")
    method = _text(v, "$.method")
    answers = _kind(v, "$.result").isNotNull() | _kind(v, "$.error").isNotNull()
    kind = F.when(_kind(v) != "OBJECT", None).when((method != "") & ((id_kind == "STRING") | number), "request").when(method != "", "notification").when(key.isNotNull() & answers, "response")
    body = F.when(kind == "response", F.to_json(F.try_variant_get(v, "$.result", "variant"))).otherwise(F.to_json(F.try_variant_get(v, "$.params", "variant")))
    return lines.select("*", kind.alias("type"), F.when(kind.isin("request", "response"), key).alias("id_key"), F.when(kind.isin("request", "notification"), method).alias("method"), body.alias("body"))


def correlated(messages: DataFrame) -> DataFrame:
    """Responses of :func:`parse_rpc` (with session_id and seq) with the method
    and seq of the last request of their id before them; a request has one
    answer, and a later one for its id is none."""
    order = Window.partitionBy("session_id", "id_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    both = messages.filter("type IN ('request', 'response')")
    before = F.last(F.struct("type", F.col("seq").alias("asked_at"), F.col("method").alias("asked"))).over(order)
    # the row before an answer: a request, or an answer that has used it
    placed = both.withColumn("r", before).filter("type = 'response' AND r.type = 'request'")
    return placed.select("session_id", "id_key", "seq", "r.asked_at", "r.asked", "body")


FIELD = T.ArrayType(
    T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType())])
)
_FIELD = pa.list_(pa.struct([("ord", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("kind", pa.string()), ("depth", pa.int32())]))


class _Broken:
    """Stands for a value that could not be read."""


def _loaded(text: str | None) -> object:
    """The value of a JSON text, or a mark for what is none, nests too deep to
    be read, or holds half a character."""
    try:
        if "\\u" in (text or ""):
            json.dumps(json.loads(text), ensure_ascii=False).encode()
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return _Broken


def _nodes(args: dict, most: int, deepest: int) -> list[dict] | None:
    """Fields in order of a walk; array elements have their field's name; None
    beyond the limits.  The walk keeps its own stack."""
    found: list[dict] = []
    stack = [(k, v, 0) for k, v in reversed(args.items())]
    while stack:
        key, node, depth = stack.pop()
        if len(found) >= most or depth > deepest:
            return None
        kind = next(n for t, n in ((bool, "boolean"), ((int, float), "number"), (str, "string"), (list, "array"), (dict, "object"), (type(None), "null")) if isinstance(node, t))
        found.append({"ord": len(found), "key": key, "value": node if kind == "string" else None, "kind": kind, "depth": depth})
        below = [(key, x) for x in node] if kind == "array" else list(node.items()) if kind == "object" else []
        stack += [(k, v, depth + 1) for k, v in reversed(below)]
    return found


@F.arrow_udf(FIELD)
def flatten_args(args: pa.Array) -> pa.Array:
    """Fields of each JSON object; null for anything else or beyond the limits."""

    def one(text: str | None) -> list[dict] | None:
        parsed = _loaded(text)
        return _nodes(parsed, MAX_FIELDS, MAX_DEPTH) if isinstance(parsed, dict) else None

    return pa.array([one(t) for t in args.to_pylist()], _FIELD)


def _role(key: str, value: str) -> str:
    folded = key.lower().replace("_", "").replace("-", "")
    for names, role in ((TEXT_KEYS, "text"), (LABEL_KEYS, "label"), (OPAQUE_KEYS, "opaque")):
        if folded in names:
            return role
    return "label" if len(value) <= TOKEN_CHARS and not any(c.isspace() for c in value) else "unknown"


def _strings(node: object) -> Iterator[tuple[str, str]]:
    """(role, text) of each string of a response in order; a limit passed is unknown."""
    stack, seen, chars = [("", node, 0)], 0, 0
    while stack:
        key, now, depth = stack.pop()
        seen += 1
        if depth > WALK_DEPTH or seen > WALK_NODES:
            yield "unknown", ""
            return
        if isinstance(now, str):
            role = _role(key, now)
            chars += len(now) * (role != "opaque")
            yield ("unknown" if chars > WALK_CHARS else role), now
        elif isinstance(now, (list, dict)):
            below = [(key, x) for x in now] if isinstance(now, list) else list(now.items())
            stack += [(k, v, depth + 1) for k, v in reversed(below)]


PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.BooleanType())]))


@F.arrow_udf(PIECES)
def extract_text(tools: pa.Array, responses: pa.Array) -> pa.Array:
    """The texts of each response, content or label; null where one is unknown
    or the response can't be read."""

    def one(tool: str | None, response: str | None) -> list[dict] | None:
        if tool in TEXTLESS or response is None:
            return []
        node = _loaded(response)
        if node is _Broken:
            return None
        if isinstance(node, str):
            return [{"text": node, "content": True}]
        found = list(_strings(node))
        if any(role == "unknown" for role, _ in found):
            return None
        return [{"text": text, "content": role == "text"} for role, text in found if role != "opaque"]

    kind = pa.list_(pa.struct([("text", pa.string()), ("content", pa.bool_())]))
    return pa.array([one(t, r) for t, r in zip(tools.to_pylist(), responses.to_pylist(), strict=True)], kind)


@F.arrow_udf(T.StringType())
def replace_text(responses: pa.Array, texts: pa.Array) -> pa.Array:
    """Each response with its texts, in the order of :func:`extract_text`,
    replaced; unchanged if their number differs or it can't be read."""

    def one(response: str | None, parts: list[str] | None) -> str | None:
        if response is None or parts is None:
            return response
        node = _loaded(response)
        if node is _Broken:
            return response
        if isinstance(node, str):
            return json.dumps(parts[0], ensure_ascii=False) if len(parts) == 1 else response
        roles = [role for role, _ in _strings(node)]
        if "unknown" in roles or sum(role in ("text", "label") for role in roles) != len(parts):
            return response
        rest = iter(parts)

        def built(key: str, now: object) -> object:
            if isinstance(now, str):
                return next(rest) if _role(key, now) in ("text", "label") else now
            if isinstance(now, list):
                return [built(key, x) for x in now]
            return {k: built(k, x) for k, x in now.items()} if isinstance(now, dict) else now

        return json.dumps(built("", node), ensure_ascii=False)

    return pa.array([one(r, p) for r, p in zip(responses.to_pylist(), texts.to_pylist(), strict=True)], pa.string())


def render_decision(kind: Column, reason: Column, args: Column, removed: Column, interactive: bool, dialect: str = "a") -> Column:
    """A decision as the harness reads it, in JSON."""
    changed = F.concat(reason, F.lit("; arguments that were cut: "), F.when(F.size(removed) > 0, F.array_join(removed, ", ")).otherwise("none"))
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    value = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"x":(.*)\}$', 1)
    if dialect == "b":
        rewrite = F.concat(F.lit('{"systemMessage":'), value(F.concat(F.lit("untrusted text removed: "), changed)), F.lit(',"hookSpecificOutput":{"hookEventName":"BeforeTool","tool_input":'), args, F.lit("}}"))
        shown = kind if interactive else F.when(kind == "ask", "deny").otherwise(kind)
        other = F.to_json(F.struct(shown.alias("decision"), reason.alias("reason")))
    else:
        head = '{"hookSpecificOutput":{"hookEventName":"PreToolUse",'
        asked = F.concat(F.lit('"permissionDecision":"ask","permissionDecisionReason":'), value(changed), F.lit(",")) if interactive else F.lit("")
        rewrite = F.concat(F.lit(head), asked, F.lit('"updatedInput":'), args, F.lit("}}"))
        other = F.concat(F.lit(head + '"permissionDecision":'), value(kind), F.lit(',"permissionDecisionReason":'), value(reason), F.lit("}}"))
    return F.when(kind == "allow", "{}").when(kind == "rewrite", rewrite).otherwise(other)


def journal(decisions: DataFrame) -> DataFrame:
    """Rows for the journal: every decision but allow."""
    return decisions.filter("decision <> 'allow'").select("at", "decision", "tool", "reason", F.col("last_source").alias("source"))


def notices(seen: DataFrame) -> DataFrame:
    """Rows for the journal that decide nothing: ``seen`` has at, tool, reason
    and source."""
    return seen.select("at", F.lit("notice").alias("decision"), "tool", "reason", "source")


def append_journal(rows: DataFrame, path: str) -> None:
    """Rows of :func:`journal` and :func:`notices` after those in ``path``, a line
    of JSON each.  A file appears whole or not at all."""
    rows.select("at", "decision", "tool", "reason", "source").write.mode("append").json(path)


def read_journal(spark, path: str) -> DataFrame:
    """The rows of a journal."""
    return spark.read.schema("at timestamp, decision string, tool string, reason string, source string").json(path)


#: Fixed value of JSON-RPC: the code of a line that can't be parsed.
PARSE_ERROR = -32700


def rpc_parse_error() -> Column:
    """The answer to a line that is no JSON."""
    return F.lit(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "the line is no JSON"}}, separators=(",", ":")))


def rpc_error(id_json: Column, text: Column) -> Column:
    """A tool's refusal as a JSON-RPC result."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), id_json, F.lit(',"result":{"content":[{"type":"text","text":'), quoted, F.lit('}],"isError":true}}'))


def findings_lines(findings: DataFrame) -> DataFrame:
    """Findings (kind, detail, sample) as tab-separated lines."""
    return findings.select(F.concat_ws("\t", "kind", "detail", "sample").alias("line"))


def findings_json(findings: DataFrame) -> DataFrame:
    """Findings as lines of JSON."""
    return findings.select(F.to_json(F.struct("kind", "detail", "sample")).alias("line"))
