"""What a session reads: sources, observed texts, taint of values, saturation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import clean as C
from tracewell.functions import text as T
from tracewell.operators import policy as G
from tracewell.operators import provenance as P
from tracewell.operators import report as R

#: Entries that a session's store holds before it stops remembering; characters of a rejection.
ENTRIES, REJECTION_CHARS = 1_000_000, 20_000
#: Kinds of source by tool, for both harnesses.
KINDS_A = {"WebFetch": "web", "WebSearch": "web", "Bash": "bash", "Read": "file", "Glob": "file", "Grep": "file", "NotebookRead": "file"}
KINDS_B = {"web_fetch": "web", "google_web_search": "web", "run_shell_command": "bash", "read_file": "file", "read_many_files": "file", "list_directory": "file", "glob": "file", "search_file_content": "file"}


def source_kind(tool: Column, server: Column | None = None, dialect: str = "a") -> Column:
    """The kind of source that a tool reads; a server's tool is just a tool."""
    table = KINDS_A if dialect == "a" else KINDS_B
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), tool), F.lit("tool"))
    return kind if server is None else F.when(server.isNotNull(), "tool").otherwise(kind)


def source_label(fields: Column, tool: Column) -> Column:
    """The first filled link of the top-level fields, else path, else the tool."""
    top = F.filter(fields, lambda f: (f["depth"] == 0) & (F.coalesce(f["value"], F.lit("")) != ""))
    first = lambda keys: F.get(F.filter(top, lambda f: G.fold_key(f["key"]).isin(*keys)), F.lit(0))["value"]
    return F.coalesce(first(G.URL_KEYS), first(G.PATH_KEYS), tool)


def sources(origins: DataFrame, trusted: Sequence[str] = (), views: Mapping[str, str] | None = None) -> DataFrame:
    """``origins`` (kind, label, tool, and server where there are servers) with
    source_id, trusted, declared_view and rendered.  An id depends on kind and
    label only; a view is declared for a tool or for ``server/tool``."""
    declared = F.lit(None).cast("string")
    if views:
        table = F.create_map(*[F.lit(x) for pair in views.items() for x in pair])
        declared = F.try_element_at(table, F.col("tool"))
        if "server" in origins.columns:
            declared = F.coalesce(F.try_element_at(table, F.when(F.col("server").isNotNull(), F.concat_ws("/", "server", "tool"))), declared)
    return origins.withColumns(
        {
            "source_id": T.window_key(F.concat("kind", F.lit("|"), "label")),
            "trusted": G.trusted(F.col("kind"), F.col("label"), trusted),
            "declared_view": declared,
            "rendered": G.rendered(F.col("kind"), declared),
        }
    )


def safe_name(session: Column) -> Column:
    """A file name for a session: readable, and distinct by digest."""
    plain = F.substring(F.regexp_replace(session, "[^a-zA-Z0-9_-]", "_"), 1, 64)
    digest = F.substring(F.sha2(session, 256), 1, 16)
    return F.when(plain == "", digest).otherwise(F.concat(plain, F.lit("-"), digest))


def rpc_texts(answers: DataFrame) -> DataFrame:
    """Texts in responses of :func:`tracewell.sources.events.correlated`: ord,
    kind, label and text; a null text is a block that can't be cleaned."""
    v = F.try_parse_json("body")
    lists = {"tools/list": "$.tools", "tools/call": "$.content", "resources/read": "$.contents", "prompts/get": "$.messages"}
    blocks = F.coalesce(*[F.when(F.col("asked") == method, F.try_variant_get(v, path, "array<variant>")) for method, path in lists.items()])
    rows = answers.select("*", F.posexplode(blocks).alias("ord", "_b"))
    read = lambda path: F.try_variant_get("_b", path, "string")
    text = (
        F.when(F.col("asked") == "tools/list", read("$.description"))
        .when(F.col("asked") == "resources/read", read("$.text"))
        .when((F.col("asked") == "tools/call") & (read("$.type") == "text"), read("$.text"))
        .when((F.col("asked") == "prompts/get") & (read("$.content.type") == "text"), read("$.content.text"))
    )
    label = F.when(F.col("asked") == "tools/list", F.coalesce(read("$.name"), F.lit(""))).when(F.col("asked") == "resources/read", F.coalesce(read("$.uri"), F.col("asked"))).otherwise(F.col("asked"))
    kind = F.when(F.col("asked") == "tools/list", "mcp-description").otherwise("tool")
    found = rows.select(*answers.columns, "ord", kind.alias("kind"), label.alias("label"), text.alias("text"))
    return found.filter("text IS NOT NULL OR asked <> 'tools/list'")


def observed(pieces: DataFrame) -> DataFrame:
    """``pieces`` (text, rendered, content) cleaned: clean, findings, substitute
    (the reader sees it rendered and something went), and recorded, the texts to
    index: the clean one, and the raw one if it differs and is handed on."""
    cleaned = pieces.withColumn("_s", C.sanitize("text")).select("*", "_s.clean", "_s.findings").drop("_s")
    substitute = F.col("rendered") & (F.size(C.removing(F.col("findings"))) > 0)
    both = F.when(substitute | (F.col("clean") == F.col("text")), F.array("clean")).otherwise(F.array("clean", "text"))
    return cleaned.withColumns({"substitute": substitute, "recorded": F.when(F.col("content"), both).otherwise(G.strings([]))})


def rejection(tool: Column, clean: Column) -> Column:
    """What a model gets instead of a result that can't be rebuilt."""
    cut = F.when(F.length(clean) > REJECTION_CHARS, "Only its first characters are given.")
    head = F.concat(F.lit("Result of "), tool, F.lit(": withheld, because it holds text that no reader would see."))
    return F.concat_ws("\n", head, F.lit("What a reader would see follows and may be used."), cut, F.substring(clean, 1, REJECTION_CHARS))


def tainted(values: DataFrame, windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(value_id, source_id, via, atom): every way in which a value carries text
    of a source: by window, by token, or by either in a decoded spelling.

    ``values`` has value_id and text.  Spellings are rows of the same joins.
    """
    spelled = values.select("value_id", F.lit("own").alias("spelling"), "text").unionAll(
        values.filter(F.col("text").rlike("[%+]")).select("value_id", F.lit("decoded").alias("spelling"), F.explode(T.decodings(F.col("text"))).alias("text"))
    )
    keyed = spelled.withColumn("value_id", F.struct("value_id", "spelling"))
    by_window = P.contained(keyed.select("value_id", "text"), windows).select("value_id", "source_id", F.lit("window").alias("via"), F.lit(None).cast("string").alias("atom"))
    named = keyed.select("value_id", F.explode(T.atoms(F.col("text"))).alias("atom"))
    by_token = named.join(tokens.select("atom", "source_id"), "atom").select("value_id", "source_id", F.lit("token").alias("via"), "atom")
    found = by_window.unionAll(by_token).distinct()
    return found.select("value_id.value_id", "source_id", F.when(F.col("value_id.spelling") == "decoded", F.concat(F.lit("decoded "), "via")).otherwise(F.col("via")).alias("via"), "atom")


def saturation(texts: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(session_id, seq, entries, saturated): entries that a session's store holds
    after each read (session_id, seq, text), and whether one was refused.

    Entries are windows by owner, four at most, and tokens by first owner.
    """
    normal = texts.select("session_id", "seq", T.normalize(F.col("text")).alias("_n"))
    rows = P.window_rows(normal.filter(F.length("_n") >= T.WINDOW), F.col("_n"), T.STEP).select("session_id", "seq", "window").distinct()
    first = Window.partitionBy("session_id", "window").orderBy("seq")
    owned = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= P.OWNERS).select("session_id", "seq")
    named = texts.select("session_id", "seq", F.explode(T.atoms(F.col("text"))).alias("a")).groupBy("session_id", "a").agg(F.min("seq").alias("seq")).select("session_id", "seq")
    new = texts.select("session_id", "seq", F.lit(0).alias("n")).unionAll(owned.unionAll(named).withColumn("n", F.lit(1)))
    order = Window.partitionBy("session_id").orderBy("seq")
    past = new.groupBy("session_id", "seq").agg(F.sum("n").alias("n")).withColumn("_past", F.sum("n").over(order))
    return past.select("session_id", "seq", F.least("_past", F.lit(most)).alias("entries"), (F.col("_past") > most).alias("saturated"))


def attributed(answers: DataFrame, index: DataFrame) -> DataFrame:
    """(value_id, source_id, fragments, covered, truncated): what each answer
    (value_id, text) has of each source, in its first characters."""
    cut = answers.select("value_id", F.substring("text", 1, R.ANSWER_CHARS).alias("text"), (F.length("text") > R.ANSWER_CHARS).alias("truncated"))
    found = P.influence(P.merged_spans(P.contained(cut.select("value_id", "text"), index), ["value_id", "source_id"]))
    return found.join(cut.select("value_id", "truncated"), "value_id")


STATE = (
    "version int, turn int, unredacted boolean, directive array<string>, exposure struct<at: int, source: string>, userAtoms array<string>, "
    "taint struct<sources: array<struct<id: string, kind: string, label: string, trust: string>>, shingles: array<array<string>>, atoms: array<array<string>>>"
)


def load_pieces(spark, path: str) -> DataFrame:
    """Saved pieces of session state, with session and piece (their file); a
    malformed one fails the read, since a broken store must not pass for an
    empty one."""
    found = spark.read.schema(f"{STATE}, session string").option("mode", "FAILFAST").json(path)
    return found.withColumn("piece", F.col("_metadata.file_name"))


def save_pieces(states: DataFrame, path: str) -> None:
    """States (with session_id) as further pieces; each file appears whole."""
    states.withColumn("session", safe_name(F.col("session_id").cast("string"))).drop("session_id").write.mode("append").partitionBy("session").json(path)


def merged_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of :func:`load_pieces` as one state a session: marks to the
    stricter reading, as :func:`tracewell.operators.session.merged_state` has
    them, and the union of taint."""
    from tracewell.operators import session as S

    flat = pieces.select(F.col("session").alias("session_id"), "piece", "turn", "unredacted", "directive", F.col("exposure.source").alias("exposure"), F.col("userAtoms").alias("user_atoms"), "taint")
    marks = S.merged_state(flat.drop("taint"))
    rows = lambda member: flat.select("session_id", F.explode(f"taint.{member}").alias("x")).distinct().groupBy("session_id").agg(F.sort_array(F.collect_list("x")).alias(member))
    for member in ("sources", "shingles", "atoms"):
        marks = marks.join(rows(member), "session_id", "left")
    return marks


def absorbed(index: DataFrame, other: DataFrame, most: int = ENTRIES) -> DataFrame:
    """The union of two stores (key, source_id) with full (nothing more fits).

    A malformed key fails the job: a broken store must not pass for an empty
    one.  Absorbing a store twice changes nothing.
    """
    checked = other.select(F.when(T.parse_key(F.col("key")).isNull(), F.raise_error(F.concat(F.lit("malformed key: "), F.coalesce("key", F.lit("null"))))).otherwise(F.col("key")).alias("key"), "source_id")
    both = index.select("key", "source_id").unionAll(checked).distinct()
    return both.withColumn("full", F.lit(both.count() >= most))
