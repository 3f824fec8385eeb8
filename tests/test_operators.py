"""Operators on small tables with known results."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import policy as G
from tracewell.operators import provenance as P
from tracewell.operators import session as S
from tracewell.plans import catalogue, decisions
from tracewell.plans import provenance as V
from tracewell.sources import events as E
from tracewell.sources import policy as L


def test_any_slice_of_39_characters_is_found(spark):
    text = "".join(random.Random(1).choice("abcdefghij ") for _ in range(300)).strip()
    text = " ".join(text.split())
    sources = spark.createDataFrame([(1, 1, text)], "source_id long, seq long, text string")
    values = spark.createDataFrame([(i, text[i : i + 39]) for i in range(len(text) - 39) if not text[i].isspace() and not text[i + 38].isspace()], "value_id long, text string")
    hits = P.contained(values, P.window_index(sources))
    assert hits.select("value_id").distinct().count() == values.count()


def test_a_value_meets_only_what_came_before(spark):
    text = "a sentence that is long enough to fill several windows of text"
    index = P.window_index(spark.createDataFrame([(1, 5, text)], "source_id long, seq long, text string"))
    values = spark.createDataFrame([(1, 4, text), (2, 6, text)], "value_id long, seq long, text string")
    assert {r.value_id for r in P.contained(values, index).collect()} == {2}


def test_owner_cap_and_spans_ignore_row_order(spark):
    text = "the same passage of text that many sources repeat word for word"
    rows = [(k, 100 - k, text) for k in range(9)]
    random.Random(2).shuffle(rows)
    index = P.window_index(spark.createDataFrame(rows, "source_id long, seq long, text string"))
    assert {r.source_id for r in index.collect()} == {5, 6, 7, 8}
    hits = spark.createDataFrame([(1, 1, a) for a in (40, 0, 8, 32, 100)], "value_id long, source_id long, at long")
    assert sorted((r.start, r.end) for r in P.merged_spans(hits, ["value_id", "source_id"]).collect()) == [(0, 72), (100, 132)]


def test_groups_of_a_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "left_id long, right_id long")
    got = {r.source_id: r.group_id for r in P.groups(pairs).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0
    assert P.groups(pairs.limit(0)).collect() == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "inside"), [("/work/a/b", True), ("/work/a", True), ("/work/ab", False), ("/work/a/../c", False), ("/work/x/../a/f", True), ("/WORK/a", False), ("", False)]
)
def test_path_bounds(spark, path, inside):
    assert one(spark, G.inside_paths(F.lit(path), ["/work/a/", " "])) is inside
    assert one(spark, G.inside_paths(F.lit(path), [" "])) is False


def test_hosts_trust_and_directive(spark):
    assert one(spark, G.host(F.lit("https://EXAMPLE.com.:8080/x"))) == "example.com"
    assert one(spark, G.inside_hosts(F.lit("https://a.example.com"), ["example.com"])) is False
    assert one(spark, G.trusted(F.lit("web"), F.lit("https://a/b/%2e%2e/c"), ["https://a/b"])) is False
    assert one(spark, G.trusted(F.lit("web"), F.lit("https://a/bc"), ["https://a/b"])) is False
    assert one(spark, G.trusted(F.lit("user"), F.lit(None).cast("string"), [])) is True
    assert one(spark, G.directive(F.lit("hello\n task: scope Read, fly\nx"))) == ["read"]
    assert one(spark, G.directive(F.lit("task: scope fly"))) == []
    assert one(spark, G.directive(F.lit("no"))) is None


def test_narrowing_is_monotone(spark):
    for effect in G.EFFECTS:
        kept = one(spark, G.narrowed(G.strings(["read", "exec"]), G.strings([effect, "read", effect])))
        assert set(kept) <= {"read", "exec"} and len(kept) == len(set(kept))


def test_cut(spark):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    assert one(spark, G.cut_spans(F.lit("keep   BAD  keep\nline"), F.array(span(5, 11), span(8, 12)))) == "keep keep\nline"
    assert one(spark, G.cut_spans(F.lit("all"), F.array(span(0, 3)))) == ""


def test_session_state_ignores_row_order(spark):
    rows = [(1, k, "user" if k % 3 == 0 else "tool", k % 3 == 1, f"s{k}") for k in range(30)]
    want = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        t = spark.createDataFrame(rows, "session_id long, seq long, role string, untrusted boolean, label string").repartition(4)
        got = sorted((r.seq, r.turn, r.exposure) for r in S.exposures(S.turns(t)).collect())
        assert want is None or got == want
        want = got
    assert want[2] == (2, 1, "s1") and want[3] == (3, 2, None)


def test_merge_of_pieces(spark):
    rows = [(1, "b", 3, False, ["read", "exec"], "x", ["p", "q"]), (1, "a", 5, True, None, None, ["q", "r"]), (1, "c", 1, False, ["exec"], "y", None)]
    got = S.merged_state(spark.createDataFrame(rows, "session_id long, piece string, turn long, unredacted boolean, directive array<string>, exposure string, user_atoms array<string>")).first()
    assert (got.turn, got.unredacted, got.directive, got.exposure, got.user_atoms) == (5, True, ["exec"], "x", ["q", "r", "p"])


def test_events_that_do_not_parse_become_rows(spark):
    lines = ["{", "[1]", "null", "", '{"hook_event_name": "PreToolUse", "tool_input": 3}', '{"hook_event_name": "PreToolUse", "tool_name": "T"}']
    got = E.parse_events(spark.createDataFrame([(x,) for x in lines], "line string")).select("kind", "session_id", "args").collect()
    assert [r.kind for r in got] == ["unparsable"] * 5 + ["call"]
    assert got[5].args == "{}" and {r.session_id for r in got} == {"default"}


def test_rpc_lines(spark):
    lines = ['{"id": 1, "method": "m"}', '{"id": "1", "result": {}}', '{"method": "n"}', '{"id": null, "error": {}}', '{"id": 2}', "x"]
    got = E.parse_rpc(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.type, r.id_key) for r in got] == [("request", "number:1"), ("response", "string:1"), ("notification", None), ("response", "object:null"), (None, None), (None, None)]


def test_argument_walk_has_limits(spark):
    import json

    deep = {"a": 1}
    for _ in range(12):
        deep = {"a": deep}
    texts = [json.dumps(deep), json.dumps({"a": list(range(3000))}), "[1]", "{}", '{"a": [1, "x"]}']
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.flatten_args("t").alias("x")).collect()]
    assert got[:3] == [None] * 3 and got[3] == [] and [(f.key, f.value, f.depth) for f in got[4]] == [("a", None, 0), ("a", None, 1), ("a", "x", 1)]


def test_policy():
    assert L.validate(None) == L.Policy()
    assert L.validate({"mode": "autonomous", "profile": {"effects": ["read"], "resources": {"hosts": ["a"]}}}).hosts == ("a",)
    for wrong in ({"mode": "x"}, {"profile": {"effects": ["fly"]}}, {"exposure": 1}, {"toolsReturn": {" ": "source"}}, {"notify": {"webhook": "u"}}, [1], {"task": 3}):
        with pytest.raises(L.PolicyError):
            L.validate(wrong)
    assert "the exposure rule is off" in L.warnings(L.validate({"exposure": False}))


def test_policy_of_a_home(spark, tmp_path):
    assert L.load(str(tmp_path)) == L.Policy()
    (tmp_path / "policy.json").write_text('{"profile": {"effects": ["read"], "resources": {"paths": ["/work"]}}}')
    policy = L.load(str(tmp_path))
    made = spark.range(1).select(L.certificate(policy, F.lit(2)).alias("c")).first().c
    assert (made.effects, made.paths, made.hosts, made.issued_at_turn, made.expires_at_turn) == (["read"], ["/work"], [], 2, None)
    (tmp_path / "policy.json").write_text('{"mode": "odd"}')
    with pytest.raises(L.PolicyError):
        L.load(str(tmp_path))


def test_sweeps_have_a_budget_for_each_directory(spark):
    rows = [(f"s{k}", f"2026-01-0{1 + k % 3} 00:00:00", "a" if k < 4 else "b") for k in range(6)]
    seen = spark.createDataFrame(rows, "session_id string, last_ts string, directory string").withColumn("last_ts", F.col("last_ts").cast("timestamp"))
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")
    got = S.expired(seen, now, 3600, keep="s0", budget=1).collect()
    assert {(r.directory, r.session_id) for r in got} == {("a", "s3"), ("b", "s4")}
    assert [r.session_id for r in S.expired(seen.drop("directory"), now, 3600, budget=2).collect()] == ["s0", "s3"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_more_users_than_a_sweep_takes_expire(spark, tmp_path, kind):
    made = F.timestamp_micros(F.when(F.col("id") % 3 == 0, F.col("id") * 100_001 - 10**9).otherwise(F.lit(10**15) - F.col("id") * 999_999))
    events = spark.range(9000).select(F.when(F.col("id") != 8, F.col("id") - 5).alias("user_id"), F.when(F.col("id") != 50, made).cast(kind).alias("ts"))
    twice = events.unionAll(events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 HOURS")))
    twice.write.parquet(str(tmp_path / "events.parquet"))
    assert decisions.ttl_sweep(spark, str(tmp_path)).count() > 5000
    assert _against_sql(spark, tmp_path, "ttl_sweep", "events") == (Counter(), Counter())


def test_a_sweep_knows_the_hour_that_comes_twice(spark, tmp_path, monkeypatch):
    import time

    ago = {1: 0, 2: 50, 3: 70}  # minutes before 1:30, the second time
    rows = spark.createDataFrame(list(ago.items()), "user_id long, m long")
    rows.select("user_id", F.timestamp_seconds(F.lit(1730615400) - F.col("m") * 60).alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    try:
        with monkeypatch.context() as m:
            m.setenv("TZ", "America/New_York")
            time.tzset()
            got = [tuple(r) for r in decisions.ttl_sweep(spark, str(tmp_path)).collect()]
    finally:
        time.tzset()
    assert got == [(3, 1730615400 - 70 * 60)]


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_imports_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tracewell", tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_whole_documents_are_quarantined(spark, tmp_path):
    tail = ("evil9.example.com " + "word " * 40)[:95]
    seam = "user@" + ("filler " * 50)[:300] + tail
    rows = [(3, "word " * 200), (6, seam), (1, "short text that only loses some of its words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.refused for r in decisions.quarantine_whole(spark, str(tmp_path)).collect()}
    assert got[3].endswith("would lose most of its text") and got[6].endswith("would name another target") and got[1] == ""


def _against_sql(spark, folder, name, table):
    """Rows of a query that its SQL lacks, and the other way round."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = Counter(con.execute(catalogue.oracle_sql()[name]).fetchall())
    got = Counter(map(tuple, catalogue.queries()[name](spark, str(folder)).collect()))
    return got - want, want - got


def test_cut_documents_are_all_there_as_in_sql(spark, tmp_path):
    tail = "and more words that stay where they are"
    seam = "Thoueesrg and more.44@mail0.example.com 19.158.174.88 and words"
    texts = [seam, "token 7 and the rest of9a1c2d3e4f5 is new here", None, "", "short", " " * 70 + "later", " " * 30, "\u00a0" * 30, " " * 5 + "\u00a0" * 15 + " " * 9, "\n" * 30, "\t" * 25 + "x"]
    texts += [f"{a}ab{'c' * 18}  \t {tail[:k]}{b}" for k in (0, 9) for a in ("", " ", "\r\n", "\f") for b in ("", " \u2028", "\x0b", "\r", " \n\t", "\u00a0", " \u0085")]
    texts += ["e\u0301" * 40, "\U0001f600" * 70, "x" * 19, "x" * 20, "x" * 21, "x" * 4000]
    rows = [(5 * k + d, t) for k, t in enumerate(texts) for d in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in decisions.quarantine_cut(spark, str(tmp_path)).collect()}
    assert (got[1].cut, got[1].refused) == ("Thoue4@mail0.example.com 19.158.174.88 and wo", "") and len(got) == len(rows)
    assert _against_sql(spark, tmp_path, "quarantine_cut", "documents") == (Counter(), Counter())


def test_every_window_has_its_key(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog again"
    spark.createDataFrame([(1, text), (2, "too short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.value_id, r["at"]): (r.fnv, r.djb) for r in V.window_keys_whole(spark, str(tmp_path)).collect()}
    want = {}
    for at in range(len(text) - 31):
        fnv, djb = 0x811C9DC5, 5381
        for c in map(ord, text[at : at + 32]):
            fnv, djb = (fnv ^ c) * 0x01000193 & 0xFFFFFFFF, djb * 33 + c & 0xFFFFFFFF
        want[1, at] = (fnv, djb)
    assert got == want


def test_malformed_events_never_fail_the_job(spark):
    deep, half = "[" * 200_000 + "]" * 200_000, '{"a": "\\ud800"}'
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["{bad", deep, half, '{"\\udc00": 1}', None, '{"text": "fine \\ud83d\\ude00"}', '{"a": ' * 5000 + "1" + "}" * 5000])], "k int, t string")
    got = {r.k: r for r in rows.select("k", "t", E.flatten_args("t").alias("f"), E.extract_text(F.lit("X"), "t").alias("p"), E.replace_text("t", F.array(F.lit("new"))).alias("n")).collect()}
    assert [got[k].f for k in (0, 1, 2, 3, 4, 6)] == [None] * 6
    assert [got[k].p for k in (0, 1, 2, 3, 6)] == [None] * 5 and got[4].p == []
    assert [got[k].n == got[k].t for k in (0, 1, 2, 3, 4, 6)] == [True] * 6
    assert got[5].n == '{"text": "new"}' and got[5].f[0]["value"] == "fine \U0001f600"
