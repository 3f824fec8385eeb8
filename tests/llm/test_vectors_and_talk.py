"""Vectors, conversations, components and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import components, neighbours, preference, simhash
from tracewell.llm.workspace import Workspace


def vectors() -> list[tuple]:
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 16))
    rows = [(int(k), list(map(float, v)), 0) for k, v in enumerate(base)]
    for k in range(60):  # pairs and small groups
        rows.append((1000 + k, list(map(float, base[k % 25] + 0.02 * rng.normal(size=16))), 1))
    centre = rng.normal(size=16)
    rows += [(2000 + k, list(map(float, centre + 0.03 * rng.normal(size=16))), 2) for k in range(90)]  # a large group
    rows += [(3000 + k, rows[0][1], 3) for k in range(5)] + [(3010, [2 * x for x in rows[0][1]], 3)]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [float("nan")] + [1.0] * 15, 0), (4003, [None] + [1.0] * 15, 0), (4004, [float("inf")] * 16, 0), (4005, [], 0), (4006, rows[0][1][:8], None), (None, rows[3][1], 0)]
    return rows + [rows[5], rows[5]]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("extra")).repartition(3)
    found = neighbours.near_vectors(table)
    got = Counter(map(tuple, found.collect()))
    good = [(i, k, np.array(v)) for i, (k, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {i: i for i in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _, v in good:
        for j, _, w in good:
            if i != j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    want = Counter((k, links[i], (c := min(least[root(i)], default=None)), k == c) for i, (k, _, _) in enumerate(rows))
    exact = sum((got & want).values()) / sum(want.values())
    assert exact >= 0.99, (got - want, want - got)
    audit = neighbours.audited(table, found, every=1).agg(F.sum("found"), F.sum("expected")).first()
    assert audit[0] >= 0.9 * audit[1]
    assert neighbours.near_vectors(table.limit(0)).collect() == []


def test_links_across_saturated_groups(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    one, two = unit(rng.normal(size=(2, 64)))
    other = unit(one + 0.255 * unit(two - (one @ two) * one))
    both = np.concatenate([unit(c + 0.006 * rng.normal(size=(20, 64))) for c in (one, other)])
    near = both @ both.T
    assert near[:20, :20].min() > near[:20, 20:].max() and (near[:20, 20:] >= 0.95).all()
    rows = [(k, list(map(float, v))) for k, v in enumerate(both)]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(k, 39, 0, k == 0) for k in range(40)]

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("count", [10_000, 150_000, 3_000_000, 300_000_000])
def test_pairs_at_the_threshold_meet_at_any_size(count):
    bits, rng = neighbours._bits(count), np.random.default_rng(6)
    tables = range(neighbours._tables_for(bits, 0.95))
    one, other = rng.normal(size=(2, 2000, 64)).astype(np.float32)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(1, keepdims=True) * one
    near = 0.95 * one + np.sqrt(1 - 0.95**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    met = (neighbours._table_keys(one, bits, tables) == neighbours._table_keys(near, bits, tables)).any(1)
    assert met.mean() >= 0.98


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)] + [(7, 7), (5, 4), (5, 4)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    by_mine, by_found = defaultdict(set), defaultdict(set)
    for x in found:
        by_mine[root(x)].add(x)
        by_found[found[x]].add(x)
    assert sorted(map(sorted, by_mine.values())) == sorted(map(sorted, by_found.values()))


def rendered(turns) -> str:
    return "".join(f"<|{r}|>\n{t}\n" for r, t in turns)


def trained(text: str, mask: str) -> list[str]:
    return [text[int(a) : int(b)] for a, b in (s.split("-") for s in mask.split(",") if s)]


def test_preference(spark):
    rows = [
        (1, False, 0, "system", "be kind"), (1, False, 1, "user", "hi"), (1, False, 2, "assistant", "hello"), (1, True, 0, "system", "be kind"), (1, True, 1, "user", "hi"), (1, True, 2, "assistant", "go away"), (1, True, 3, "user", "why"), (1, True, 4, "assistant", "so"),
        (2, False, 0, "user", "only one side"),
        (3, False, 0, "user", "same"), (3, True, 0, "user", "same"), (3, True, 0, "user", "same"),
        (4, False, 0, None, None), (4, True, 0, "user", ""), (4, False, 70, "assistant", "late é"), (4, True, 70, "assistant", ""),
        (None, False, 0, "user", "x"), (5, None, 0, "user", "x"), (5, True, None, "user", "x"),
        (6, False, 0, "user", "b"), (6, False, 0, "user", "a"), (6, True, 0, "user", "a"),
    ]
    table = spark.createDataFrame(rows, "pair_id long, rejected boolean, turn long, role string, text string").withColumn("chosen", F.lit("extra")).withColumn("PROMPT", F.lit(9))
    got = {r.pair_id: r for r in preference.preference_pairs(table).collect()}
    assert set(got) == {1, 3, 4, 6}
    assert got[1].prompt == rendered([("system", "be kind"), ("user", "hi")]) and got[1].n_prompt_turns == 2
    assert got[1].chosen == rendered([("assistant", "hello")]) and trained(got[1].chosen, got[1].chosen_mask) == ["hello\n"]
    assert trained(got[1].rejected, got[1].rejected_mask) == ["go away\n", "so\n"]
    assert got[3].prompt == rendered([("user", "same")]) and got[3].chosen == got[3].rejected == ""
    assert got[4].chosen == rendered([("unknown", ""), ("assistant", "late é")]) and got[4].prompt == ""
    assert trained(got[4].chosen, got[4].chosen_mask) == ["late é\n"]
    assert got[6].prompt == rendered([("user", "a")]) and got[6].chosen == rendered([("user", "b")])
    assert preference.preference_pairs(table.limit(0)).collect() == []


def test_preference_of_long_conversations_and_texts(spark):
    say = lambda k: ("assistant" if k % 2 else "user", f"turn {k} " + "é" * (200_000 if k == 7 else k))
    shared = [say(k) for k in range(130)]
    sides = {False: [*shared, ("assistant", "yes")], True: [*shared, ("assistant", "no"), ("user", "?"), ("assistant", "no!")]}
    rows = [(9, side, k, *turn) for side, turns in sides.items() for k, turn in enumerate(turns)]
    (got,) = preference.preference_pairs(spark.createDataFrame(rows, "pair_id long, rejected boolean, turn int, role string, text string").repartition(7)).collect()
    assert got.n_prompt_turns == 130 and got.prompt == rendered(shared)
    assert got.chosen == rendered(sides[False][130:]) and got.rejected == rendered(sides[True][130:])
    assert trained(got.chosen, got.chosen_mask) == ["yes\n"] and trained(got.rejected, got.rejected_mask) == ["no\n", "no!\n"]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def similar_by_hand(rows) -> list[int]:
    """The least id of each group of rows whose five-word shingles are similar."""
    def shingles(text):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4) if words else 0))

    sets = {doc: shingles(text) for doc, text in rows}
    left, found = sorted(sets), []
    while left:
        group, rest = [left[0]], left[1:]
        for doc in group:
            near = [d for d in rest if sets[d] == sets[doc] or len(sets[d] & sets[doc]) >= 0.8 * len(sets[d] | sets[doc])]
            group += near
            rest = [d for d in rest if d not in near]
        found.append(min(group))
        left = rest
    return sorted(found)


def test_pipeline(spark, raw):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    work, docs, sizes = Workspace(spark, "test-pipeline"), raw, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = work.save(stage(spark, docs, "/root/testdata/sf0.001"), str(k))
        if k < 4:
            assert after.dtypes == docs.dtypes
        if name == "near-duplicates":
            ids = [r.doc_id for r in after.select("doc_id").collect()]
            assert sorted(ids) == similar_by_hand([(r.doc_id, r.text) for r in docs.collect()])
        sizes.append(after.count())
        docs = after
    assert sizes[0] < raw.count() and sizes[3] >= sizes[2] and sizes[4] >= sizes[3]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_stages_handle_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 200, "en", None, 1), (3, long, "en", "a", 1), (4, long, None, "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, schema).withColumn("KEPT", F.lit("x")).withColumn("_tw_row", F.lit("y"))
    want = {
        "quality rules": rows[4:],
        "line dedup": [(None, "", None, None, None), *rows[1:]],
        "near-duplicates": [rows[1], rows[3], rows[4]],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, table, "").collect()
        assert stage(spark, table.limit(0), "").collect() == []
        if name in want:
            assert Counter(map(tuple, got)) == Counter((*row, "x", "y") for row in want[name])
        elif name == "source mixing":
            # every row once at least, and a source no more than the largest is long
            counts, words = Counter(map(tuple, got)), {row: len((row[1] or "").split()) + 1 for row in rows}
            assert set(counts) == {(*row, "x", "y") for row in rows}
            used = Counter()
            for row, n in counts.items():
                used[row[3]] += n * words[row[:5]]
            assert max(used.values()) <= 303
        else:
            assert Counter(r.doc_id for r in got) == Counter(row[0] for row in rows)
            assert {r.doc_id: r.length for r in got}[None] == 1 and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


def test_stage_takes_near_copies_and_no_others(spark):
    rng = random.Random(11)
    texts, copies, other = [], [], []
    for _ in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        changed = list(words)
        for at in rng.sample(range(300), 5):
            changed[at] = "changed"
        texts.append(" ".join(words))
        copies.append(" ".join(changed))
        other.append(" ".join(words[:150] + [f"v{rng.randint(0, 5000)}" for _ in range(150)]))
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert all(near(a, b) >= 0.8 > near(a, c) for a, b, c in zip(texts, copies, other, strict=True))
    rows = list(enumerate([*texts, *copies, *other]))
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(40), *range(80, 120)]


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = np.random.default_rng(5)
    sets, met = {}, []
    for key in range(4):  # chains: each set is similar to the next, not to the least
        base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        for k in range(25):
            sets[100 * key + k] = np.unique(base[8 * k : 8 * k + 100])
        sets[100 * key + 50] = np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64))
        met += [(key, node, 26, 100 * key) for node in sorted(sets) if node // 100 == key]
    met += [(9, 0, 2, 0), (9, 100, 2, 0), (8, 0, 2, 0), (8, 1, 2, 0)]
    work = Workspace(spark, "test-blocks")
    table = work.save(spark.createDataFrame(met, "key long, node long, n long, low long"), "met")
    bodies = work.save(spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, shingles binary"), "sets")
    links = [(r.a, r.b) for r in simhash._similar(table, bodies, work).collect()]
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    assert all(similar(a, b) for a, b in links)
    parent = {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    assert all((root(a) == root(b)) == (a // 100 == b // 100 and a % 100 < 50 and b % 100 < 50) for a in sets for b in sets if a != b)


def test_stage_keeps_rows_whose_ids_are_null_or_repeated(spark):
    text = lambda k: " ".join(f"t{k}w{n}" for n in range(100))
    rows = [(None, text(0)), (None, text(1)), (1, text(2)), (5, text(2)), (5, text(3)), (7, text(4)), (7, text(5)), (7, text(5))]
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(map(tuple, got)) == Counter([(None, text(0)), (None, text(1)), (1, text(2)), (5, text(3)), (7, text(4)), (7, text(5))])
