"""Document operators against brute force, on rows made to be awkward."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import golay, line_dedup, mixing, packing, pieces, pii, quality, simhash, substring, tokens
from tracewell.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), say(9)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n ", "en", "a", 5), (4, "one", "en", "b", 3), (5, "one two", None, "b", 7), (None, say(80), "en", "a", 1),
        (6, "\n".join([line] * 12), "en", "a", 1), (7, say(6000) + " " + passage + "\n" + say(4000), "fr", "c", 1), (8, "x" * 5000, "en", "c", 1),
    ]
    for k in range(10, 50):
        parts = [say(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if k % 2 == 0:
            parts.insert(rng.randint(0, len(parts)), f"  {line.upper()}\t" if k % 4 else line)
        rows.append((k, rng.choice(["\n", " \n"]).join(parts), "en", rng.choice("abc"), 1))
    base = say(300)
    for k in range(60, 75):  # near copies
        words = base.split()
        words[k] = "changed"
        rows.append((k, " ".join(words), "en", "a", 1))
    rows += [(80 + k, rows[-1][1], "en", "b", 1) for k in range(12)]  # copies
    rows += [rows[20], rows[20], rows[0]]  # repeated rows
    return rows


ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Columns named like results and like a plan's own."""
    plans = ("_tw_row", "_tw_words", "_tw_source", "_tw_order", "_0", "_1", "length", "tie", "print", "body", "a.b")
    for name in ("KEPT", "N_WORDS", "n_tokens", "Copies", "h", "key", "pos", "row", "part", "spans", "keep", "n_lines", "at", *plans):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs


def counted(rows) -> Counter:
    return Counter(map(tuple, rows))


def test_quality_rules(docs):
    got = quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept", "clean_text").collect()
    normal = lambda s: re.sub(r"[ \t-\r]+", " ", s.translate({**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(49, 58)}})).strip(" ")
    holders = defaultdict(list)
    for doc, text, _, host, _ in ROWS:
        for key in {normal(x) for x in (text or "").split("\n") if WORDS.search(x)}:
            holders[host, key].append(doc)
    want = []
    for doc, text, _, host, _ in ROWS:
        words, lines = WORDS.findall(text or ""), (text or "").split("\n")
        grams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
        repeated = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        real = [x for x in lines if WORDS.search(x)]
        lost = lambda x: (h := holders[host, normal(x)]) and len(h) > 10 and doc != min((d for d in h if d is not None), default=None)  # noqa: B023, E731
        kept_words = len(words) - sum(len(WORDS.findall(x)) for x in real if lost(x))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        clean = text if not any(lost(x) for x in real) else "\n".join(x for x in lines if not (WORDS.search(x) and lost(x)))
        want.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(real) - len(set(real)), len(repeated), kept_words, failed, not failed and 100 * kept_words >= 30 * len(words), clean))
    assert counted(got) == counted(want)
    assert any(w[6] < w[1] for w in want)


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = pieces.load(path)
    got = tokens.token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = []
    for doc, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert counted(got) == counted(want)


def test_batches_keep_their_documents():
    """One Arrow batch in many lots gives what one lot gives."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, encode, _):
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ROWS], pa.int64()), pa.array([r[1] for r in ROWS])], ["doc_id", "text"])
            return [row for out in encode(iter([batch])) for row in zip(*(c.to_pylist() for c in out.columns), strict=True)]

    path, whole = public_tokenizers.path("word_bpe_49k.json"), pieces.BATCH_CHARS
    want = packing.pieces(Rows(), path)
    pieces.BATCH_CHARS = 500
    try:
        assert packing.pieces(Rows(), path) == want
        assert [len(g) for g in pieces.by_size(["a" * 300] * 5)] == [2, 2, 1]
    finally:
        pieces.BATCH_CHARS = whole
    assert {w[0] for w in want} == {r[0] for r in ROWS}


def test_cached_pieces_equal_the_library():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "é", " ", "  ", ",", ".", "\n", "\t", "'s", "ll", "<|endoftext|>", "1", "_", "-", "中", " ", "　", "​", "H̱", "\x1c", "\x85", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for name, made in (("byte_bpe_50k.json", pieces.TokenCounter), ("word_bpe_49k.json", pieces.TokenIds)):
        path = public_tokenizers.path(name)
        want = [e.ids for e in pieces.load(path).encode_batch(texts, add_special_tokens=False)]
        got = made(path, 50)(texts)
        assert got == ([len(w) for w in want] if made is pieces.TokenCounter else [np.array(w, "<u4").tobytes() for w in want])
    assert all("".join(pieces.chunks(t, 5)) == t for t in texts)


def test_golay_code():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    assert np.array_equal(golay.index(v ^ np.uint32(0)), golay.index(v))
    counts = np.bincount(golay.index(np.arange(1 << 23, dtype=np.uint32)), minlength=4096)
    assert (counts == 2048).all()  # a perfect code
    found, mask = golay.nearby(v, 23)
    assert set(mask.sum(1)) <= {1, 6}
    flipped = v ^ (1 << rng.integers(0, 23, len(v))).astype(np.uint32)
    own = golay.index(flipped)
    assert all(own[i] in found[i] for i in range(len(v)))


def test_fuzzy_keys_find_every_pair_within_three_bits():
    rng = np.random.default_rng(2)
    for errors in (0, 1, 2, 3):
        a = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
        b = a.copy()
        for i in range(len(a)):
            for bit in rng.choice(64, errors, replace=False):
                b.view(np.uint64)[i] ^= np.uint64(1) << np.uint64(bit)
        ka, oa = simhash.fuzzy_keys(a)
        kb, ob = simhash.fuzzy_keys(b)
        of_a, of_b = defaultdict(set), defaultdict(set)
        for k, o in zip(ka, oa, strict=True):
            of_a[o].add(k)
        for k, o in zip(kb, ob, strict=True):
            of_b[o].add(k)
        assert all(of_a[i] & of_b[i] for i in range(len(a)))


def brute_components(values: dict, linked) -> dict:
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(values)
    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(values[a], values[b]):
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def brute_print(text) -> int:
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = {(doc, text): brute_print(text) for doc, text, *_ in ROWS}
    roots = brute_components({p: p for p in prints.values()}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (doc, _), p in prints.items():
        if doc is not None:
            least[roots[p]].append(doc)
    want = [(doc, p if p < 1 << 63 else p - (1 << 64), min(least[roots[p]], default=None)) for doc, text, *_ in ROWS for p in [prints[doc, text]]]
    assert counted(got) == counted(want)
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_large_keys_are_dealt_again_exactly(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 62, 3, dtype=np.int64)
    prints = np.unique(np.concatenate([c ^ (np.int64(1) << rng.integers(0, 62, 1500)) ^ (np.int64(1) << rng.integers(0, 62, 1500)) for c in centre]))
    want, whole = simhash._forest(prints), simhash.LARGE
    simhash.LARGE = 100
    try:
        table = spark.createDataFrame([(int(p),) for p in prints], "print long").repartition(3)
        got = list(zip(*simhash.near_links(table, Workspace(spark, "test-links")).collect(), strict=True))
    finally:
        simhash.LARGE = whole

    def parts(links):
        parent = {int(p): int(p) for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(*links, strict=True):
            assert int(a ^ b).bit_count() <= 3
            parent[root(int(a))] = root(int(b))
        return sorted(sorted(p for p in parent if root(p) == r) for r in {root(p) for p in parent})

    assert parts(got) == parts(want)


def test_substring(docs):
    got = substring.remove_repeated(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    rows = sorted(set((d if d is not None else 1 << 62, xxh(t), t or "", d) for d, t, *_ in ROWS))
    seen, kept = set(), {}
    for _, _, text, doc in rows:
        words, gone = WORDS.findall(text), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept[doc, text] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    want = [(doc, *kept[doc, text or ""]) for doc, text, *_ in ROWS]
    assert counted(got) == counted(want)
    assert sum(w[2] > 0 for w in want) > 20


def xxh(text) -> int:
    """Spark's order of rows that share an id."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_factors_point_at_their_text(docs):
    texts = {d: WORDS.findall(t or "") for d, t, *_ in ROWS if d is not None}
    checked = 0
    for row in substring.remove_repeated(docs).filter("doc_id IS NOT NULL").collect():
        for f in row["factors"]:
            own = texts[row["doc_id"]][f["start"] : f["start"] + f["length"]]
            assert len(own) >= 20
            if f["ref_doc"] in texts:
                assert own == texts[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["length"]]
                checked += 1
    assert checked


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, keep_first, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUFFER_LINES", 40)
    got = line_dedup.line_dedup(docs, keep_first=keep_first).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    places = defaultdict(set)
    rank = lambda d: (d is None, d)
    for doc, text, *_ in ROWS:
        for i, line in enumerate((text or "").split("\n")):
            if key(line):
                places[key(line)].add((rank(doc), i))
    gone = {k for k, v in places.items() if len({p[0] for p in v}) >= 10}
    want = []
    for doc, text, *_ in ROWS:
        lines = (text or "").split("\n")
        drop = [key(x) in gone and not (keep_first and min(places[key(x)]) == (rank(doc), i)) for i, x in enumerate(lines)]
        want.append((doc, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)))
    assert counted(got) == counted(want)
    assert sum(w[2] for w in want) > 20


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = pieces.load(path)
    got = packing.best_fit(docs, path, capacity=128).collect()
    want = Counter()
    for doc, text, *_ in ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 128)):
            want[doc, k, at, len(ids[at : at + 128]), zlib.crc32(ids[at : at + 128].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= decreasing_best_fit([r.length for r in got], 128)


def decreasing_best_fit(lengths, capacity) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


def sweep_by_hand(sizes) -> list[tuple[int, int]]:
    """Each piece, from large to small, takes the smallest gap before it."""
    free, met = [], []
    for place, is_gap in enumerate(sizes):
        if is_gap:
            free.append(place)
        elif free:
            met.append((free.pop(), place))
    return met


def test_sweeps_and_what_they_carry():
    rng = np.random.default_rng(9)
    for _ in range(60):
        gap = rng.random(rng.integers(1, 80)) < rng.random()
        want = sweep_by_hand(gap)
        assert sorted(zip(*packing.meet(gap), strict=True)) == sorted(want)
        # the same in three ranges: what they leave meets by rank
        cuts = sorted(rng.integers(0, len(gap) + 1, 2))
        met, left, free = [], {}, {}
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(gap)], strict=True)):
            here = [(int(g) + a, int(p) + a) for g, p in zip(*packing.meet(gap[a:b]), strict=True)]
            met += here
            used = {x for pair in here for x in pair}
            left[part] = [x for x in range(a, b) if not gap[x] and x not in used]
            free[part] = [x for x in range(a, b) if gap[x] and x not in used]
        for part, rank, of, top, n, _ in packing.carried({k: len(v) for k, v in left.items()}, {k: len(v) for k, v in free.items()}):
            met += [(free[of][top - i], left[part][rank + i]) for i in range(n)]
        assert sorted(met) == sorted(want)


def test_rounds_pack_as_well_as_best_fit(spark):
    rng = random.Random(9)
    for lengths in ([rng.randint(1, 60) for _ in range(500)], [31] * 40 + [30] * 41 + [1] * 7, [60] * 5, [rng.choice((1, 2, 29)) for _ in range(300)]):
        work = Workspace(spark, "test-packing")
        sizes = work.save(spark.createDataFrame([(k, n, "extra") for k, n in enumerate(lengths)], "ROW long, length long, gap string"), "sizes")
        got = packing.pack(sizes, work, 60).collect()
        assert sorted((r.ROW, r.length, r.gap) for r in got) == [(k, n, "extra") for k, n in enumerate(lengths)]
        used = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == used[r.sequence_id]
            used[r.sequence_id] += r.length
        assert max(used.values()) <= 60
        assert len(used) <= 1.01 * decreasing_best_fit(lengths, 60) + 1


def test_mixing(docs):
    got = mixing.mixture(docs, max_repetition=2.0, block_rows=4).collect()
    n = lambda t: len(WORDS.findall(t or "")) + 1
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, n(t)) for d, t, *_ in ROWS)
    assert all(r.copies >= 1 for r in got)
    tokens_of, used, target = Counter(), Counter(), {}
    for r in got:
        tokens_of[r.source] += r.n_tokens
        used[r.source] += r.n_tokens * r.copies
        target[r.source] = r.target_tokens
    longest = max(r.n_tokens for r in got)
    for source, wanted in target.items():
        assert tokens_of[source] <= wanted <= 2 * tokens_of[source] + 1
        assert wanted - longest <= used[source] <= wanted
    assert max((target[s] + 1) / tokens_of[s] for s in target) >= 1.98


def test_mixing_to_an_entropy(docs):
    got = mixing.mixture(docs, target_entropy=1.3, budget=5000).select("source", "weight", "target_tokens").distinct().collect()
    weights = np.array([r.weight for r in got])
    assert weights.sum() == pytest.approx(1)
    assert -(weights * np.log(weights)).sum() == pytest.approx(1.3, abs=0.01)
    assert sum(r.target_tokens for r in got) == pytest.approx(5000, abs=4)


PRIVATE = [
    ("mail a.b@c.de, x@y and q%w@e-f.g.h.", "email:5:13,email:23:34"),
    ("ip 1.2.3.4 999.1.1.1 1.2.3 10.20.30.40.50", "ip:3:10,ip:27:38"),
    ("card 4111 1111 1111 1111 or 4111111111111112", "card:5:24"),
    ("call +1 (906) 555-7738 or +123", "phone:5:22"),
    ("a@b.c%d@e.f", "email:0:5,email:5:11"),
    ("@@@ + @a.b", ""),
    ("", ""),
]


def test_base_spans():
    for text, want in PRIVATE:
        assert pii._said(pii.base_spans(text)) == want
    long = "a" * 200_000 + "@" + "b" * 200_000 + "1" * 200_000
    assert pii.base_spans(long) == []
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@%- ") for _ in range(rng.randint(0, 25)))
        assert list(pii.emails(text)) == [m.span() for m in pattern.finditer(text)]
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice("12.. a") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in ip.finditer(text)]


def test_repeats_take_the_label_of_a_named_one(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        number = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((k, f"lorem {number} ipsum m{k}@x.example dolor 10.{k % 250}.3.4 sit {rng.randint(100, 999)} items in {rng.randint(1900, 2030)}"))
    rows.append((1000, "call +1 (906) 555-7738 today, and again later by 906-555-7738 please, 12 apples"))
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1000]["base_spans"] == "phone:5:22"
    assert found[1000]["spans"].startswith("phone:5:22,phone:")
    assert all(r["spans"].startswith(r["base_spans"].split(",")[0]) for r in found.values())
    assert sum(len(r["spans"]) > len(r["base_spans"]) for k, r in found.items() if k < 1000) <= 6


def test_loopy_messages_on_a_tree_are_exact():
    rng = np.random.default_rng(0)
    field = pii.SkipChain(np.zeros((1, 5)), rng.normal(size=(5, 5)), (lambda m: m + m.T)(rng.normal(size=(5, 5))))
    unary, chain, skip = rng.normal(size=(4, 5)), np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    joint = np.zeros((5,) * 4)
    for y in np.ndindex(joint.shape):
        joint[y] = np.exp(sum(unary[i, y[i]] for i in range(4)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[0], y[3]])
    joint /= joint.sum()
    want = [joint.sum(tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(field.posterior(unary, chain, skip), want, atol=1e-3)


#: The contract's patterns, read as they stand.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text: str) -> list[tuple[str, int, int]]:
    def holds(kind: str, match: str) -> bool:
        digits = [int(c) for c in match if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            doubled = [x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(kind, m.start(), m.end()) for kind, pattern in BASE.items() for m in re.finditer(pattern, text) if holds(kind, m[0])]


def test_the_whole_personal_data_query(spark, tmp_path):
    rng = random.Random(8)
    bits = ["a.b", "@", "x-1", ".", "co", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+", "(0)", "192.168.0.1", "999.1.1.1", "1.2.3.4.5.6", "é", "\n", "0", "55", "-", "378282246310005000"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, rows[7][1]), (None, rows[8][1]), (7, rows[9][1]), (403, "call +44 20 7946 0958 " * 3000 + "9" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for path, table in ((str(tmp_path), rows), ("/root/testdata/sf0.001", None)):
        table = table or [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        got = pii.op4_personal_data(spark, path).collect()
        want = Counter()
        for doc, text in table:
            spans = base_by_hand(text or "")
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            want[doc, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(said.encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:-1] for r in got) == want
        texts = defaultdict(list)
        for doc, text in table:
            texts[doc].append(text or "")
        for r in got:
            listed = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
            assert listed == sorted(listed, key=lambda s: (list(BASE).index(s[0]), s[1], s[2]))
            assert any(set(base_by_hand(t)) <= set(listed) and all(b <= len(t) for _, _, b in listed) for t in texts[r.doc_id])


OPERATORS = {
    "quality": lambda d: quality.quality_rules(d),
    "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "simhash": lambda d: simhash.near_duplicates(d),
    "pii": lambda d: pii.find_personal_data(d),
    "substring": lambda d: substring.remove_repeated(d),
    "packing": lambda d: packing.best_fit(d, public_tokenizers.path("word_bpe_49k.json")),
    "mixing": lambda d: mixing.mixture(d),
    "lines": lambda d: line_dedup.line_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(name, docs, empty):
    assert OPERATORS[name](empty).collect() == []
    few = docs.filter("doc_id < 20 OR doc_id IS NULL")
    extra = OPERATORS[name](clashing(few))
    plain = OPERATORS[name](few)
    assert set(plain.columns) <= set(extra.columns)
    digest = lambda df: counted(df.select(*[F.col(c).cast("string") for c in sorted(plain.columns)]).collect())
    assert digest(extra) == digest(plain)


