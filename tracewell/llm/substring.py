"""Substring dedup by a relative Lempel-Ziv parse against earlier text.

A window is ``width`` consecutive words of one document.  The reference of a
window is its first occurrence in the corpus, in order of document and place.
A document is parsed greedily: a factor goes on while the references of
consecutive windows are consecutive in one block of earlier text, and where it
ends the windows across its boundary are looked up as well, so the parse loses
none.  Factors are ``width`` words or longer, and the words that they cover are
the duplicate spans.

The index of earlier text is cut into blocks by ranges of hashes, so a document
is parsed against every block.  Looking up every window would shuffle every
word.  So the index holds anchors first: the k-gram of least hash among those of
a window, which equal windows share.  Only windows whose anchor occurs elsewhere
are looked up themselves.

Each task first looks over its own rows: what repeats there is settled on the
spot and travels with its document, and one row for each different hash goes to
the lookup, so no hash has more than a row from each task's buffer.  Rows travel
as compressed columns, a body for each block.

Texts don't travel.  What the blocks know of a document is gathered into a row
of it, its anchors first and its factors in the end, and these rows meet the
documents where they are read: by broadcast where they are measured as small, by
a join that shuffles both sides beyond.

Windows are compared by 64-bit hashes of their words.

Defined results: a null text has no words; fewer words than a window are never
a duplicate; rows that share an id are parts of one document, in order of the
hash of their text, and rows alike in id and text are one part, so they do not
make each other duplicates; rows with a null id come after all others; a very
long text is one row, its windows are looked over in lots of bounded size; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.workspace import Workspace, broadcast_if_small, read_documents

WIDTH, GRAM = 20, 8
#: Ranges that one partition works through one after the other: more hold fewer
#: rows in memory at once, and send more bodies.
RANGES = 1
#: Rows that a task looks over at once.
BUFFER_ROWS = 300_000
CACHE_WORDS = 300_000
#: Text and factors of a batch of results.
BATCH_BYTES = 4_000_000
LAST = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

#: kind 0: rows with a hash; 1: rows about places, for their document.
_SCHEMA = "part int, sub int, kind int, doc long, piece long, body binary"
_NAMES = ["part", "sub", "kind", "doc", "piece", "body"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _body(columns: list[np.ndarray]) -> bytes:
    head = struct.pack("<I", len(columns[0]))
    return zstandard.compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _columns(body: bytes, types: str) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    (rows,) = struct.unpack_from("<I", data)
    found, at = [], 4
    for t in types.split():
        found.append(np.frombuffer(data, t, rows, at))
        at += rows * np.dtype(t).itemsize
    return found


def _ranges(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values.view(np.uint64) >> np.uint64(40)) * np.uint64(parts * RANGES) >> np.uint64(24)).astype(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64) * np.uint64(BASE)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _bodies(where: np.ndarray, columns: list[np.ndarray], kind: int) -> list[tuple]:
    """Rows of the transport schema: a body for each range in ``where``."""
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    return [(int(where[g[0]]) // RANGES, int(where[g[0]]) % RANGES, kind, 0, 0, _body([c[g] for c in columns])) for g in np.split(order, cuts) if len(g)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


class Words:
    """Hashes of the words and windows of texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def windows(hashes: np.ndarray, width: int) -> np.ndarray:
        """A polynomial hash of each ``width`` consecutive words."""
        n = len(hashes)
        powers, inverses = np.full(n, BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        powers[:1] = inverses[:1] = 1
        powers, inverses = np.cumprod(powers), np.cumprod(inverses)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers, out=sums[1:])
        return _mixed((sums[width:] - sums[:-width]) * inverses[: n - width + 1])


def anchors(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each anchor by place of its k-gram, and each window's anchor."""
    grams = Words.windows(hashes, gram)
    best = sliding_window_view(grams, width - gram + 1).argmin(1) + np.arange(len(hashes) - width + 1)
    return grams, best


class _Buffer:
    """Rows (hash, doc, piece, pos) of a task, settled in bounded lots."""

    def __init__(self, parts: int, settle):
        self.parts, self.settle = parts, settle
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, hashes: np.ndarray, doc: int, piece: int, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(hashes)
        self.rows.append((hashes, np.full(n, doc, np.int64), np.full(n, piece, np.int64), pos.astype(np.int32)))
        self.held += n
        if self.held >= BUFFER_ROWS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        if not self.rows:
            return _batch([])
        columns = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        self.rows, self.held = [], 0
        order = np.lexsort((*columns[:0:-1], columns[0]))
        return _batch(self.settle(*(c[order] for c in columns), self.parts))


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal hashes start, and the run of each row."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _settle_anchors(h, doc, piece, pos, parts):
    """An anchor that repeats here is one of interest; a row of each goes on."""
    starts, run = _runs(h)
    many = np.diff(np.append(starts, len(h))) > 1
    here = many[run]
    ahead = _bodies(_ranges(h[starts], parts), [h[starts], doc[starts], piece[starts], pos[starts], many.astype(np.int8)], 0)
    return ahead + _bodies(_ranges(_mixed(doc[here]), parts), [doc[here], piece[here], pos[here]], 1)


def _settle_windows(h, doc, piece, pos, parts):
    """A window seen here before has that place as its reference."""
    starts, run = _runs(h)
    first = starts[run]
    again = (doc != doc[first]) | (piece != piece[first]) | (pos != pos[first])
    ahead = _bodies(_ranges(h[starts], parts), [h[starts], doc[starts], piece[starts], pos[starts]], 0)
    found = [doc[again], piece[again], pos[again], doc[first][again], pos[first][again]]
    return ahead + _bodies(_ranges(_mixed(found[0]), parts), found, 1)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted transport rows in lists, one for each range."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
            if rows and row[1] != rows[0][1]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _looked_up(parts: int, types: str, settle):
    """A task over hash ranges: joins the rows of each and settles their runs.

    What was settled before the lookup is handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            out, settled = [], [r for r in rows if r[2] == 1]
            open_rows = [_columns(r[5], types) for r in rows if r[2] == 0]
            if open_rows:
                columns = [np.concatenate(c) for c in zip(*open_rows, strict=True)]
                order = np.lexsort((*columns[3:0:-1], columns[0]))
                out = settle([c[order] for c in columns])
            yield _batch(settled + (_bodies(_ranges(_mixed(out[0]), parts), out, 1) if out else []))

    return run


def _shared_anchors(columns: list[np.ndarray]) -> list[np.ndarray]:
    h, doc, piece, pos, many = columns
    starts, run = _runs(h)
    sizes = np.diff(np.append(starts, len(h)))
    shared = (sizes > 1) | (np.bincount(run, weights=many, minlength=len(starts)) > 0)
    keep = shared[run]
    return [doc[keep], piece[keep], pos[keep]]


def _later_windows(columns: list[np.ndarray]) -> list[np.ndarray]:
    h, doc, piece, pos = columns
    starts, run = _runs(h)
    first = starts[run]
    again = (doc != doc[first]) | (piece != piece[first]) | (pos != pos[first])
    return [doc[again], piece[again], pos[again], doc[first][again], pos[first][again]]


_GATHERED = "doc long, piece long, places binary"


def _gathered(types: str, made):
    """A row for each document that the blocks know places of: what ``made``
    says of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            of = _Places([r[5] for r in rows if r[2] == 1], types).of
            keys = list(of)
            for lot in (keys[k : k + 10_000] for k in range(0, len(keys), 10_000)):
                doc, piece = zip(*lot, strict=True)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int64()), pa.array([made(of[key]) for key in lot], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "places"])

    return run


def _steps(places: list[np.ndarray]) -> bytes:
    """Places in order as their distances, which are small."""
    return _body([np.diff(np.unique(places[0]), prepend=0).astype(np.int32)])


class _Places:
    """Rows about places, grouped by document and piece."""

    def __init__(self, bodies: list[bytes], types: str):
        columns = [np.concatenate(c) for c in zip(*(_columns(b, types) for b in bodies), strict=True)] if bodies else None
        self.of: dict[tuple[int, int], list[np.ndarray]] = {}
        if columns and len(columns[0]):
            order = np.lexsort((columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                self.of[int(columns[0][a]), int(columns[1][a])] = [c[a:b] for c in columns[2:]]


def factors(places: list[np.ndarray] | None, width: int) -> list[np.ndarray]:
    """The greedy parse of one document from its looked-up windows: start,
    length, ref_doc and ref_start of each factor."""
    if places is None:
        return [np.empty(0, t) for t in (np.int32, np.int32, np.int64, np.int32)]
    pos, ref_doc, ref_pos = places
    fresh = np.ones(len(pos), bool)
    fresh[1:] = pos[1:] != pos[:-1]
    pos, ref_doc, ref_pos = pos[fresh], ref_doc[fresh], ref_pos[fresh]
    cut = np.ones(len(pos), bool)
    cut[1:] = (np.diff(pos) != 1) | (np.diff(ref_doc) != 0) | (np.diff(ref_pos) != 1)
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(pos))) + width - 1
    return [pos[starts], lengths.astype(np.int32), ref_doc[starts], ref_pos[starts]]


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_removed, the factors that
    repeat earlier text, and kept_text (the other words joined by spaces).

    ``ref_doc`` of a factor is an id, or the largest long for a null one.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "substring")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    repeated = not ids.groupBy("id").count().filter("count > 1").isEmpty()
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"),
        (F.xxhash64(text_col) if repeated else F.lit(0).cast("long")).alias("piece"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("sub", "kind", "doc", "piece")

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buffer = Words(), _Buffer(parts, _settle_anchors)
        for batch in batches:
            for doc, piece, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                split = text.as_py().encode().split()
                if len(split) >= width:
                    grams, best = anchors(words.hashes(split), width, gram)
                    at = np.unique(best)
                    yield from buffer.add(grams[at], doc, piece, at)
        yield buffer.flush()

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buffer = Words(), _Buffer(parts, _settle_windows)
        for batch in batches:
            for doc, piece, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                hashes = words.hashes(text.as_py().encode().split())
                _, best = anchors(hashes, width, gram)
                shared = np.zeros(len(hashes), bool)
                shared[np.cumsum(_columns(places.as_py(), "i4")[0])] = True
                starts = np.flatnonzero(shared[best])
                yield from buffer.add(Words.windows(hashes, width)[starts], doc, piece, starts)
        yield buffer.flush()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                split = text.as_py().encode().split()
                parsed = _columns(places.as_py(), "i4 i4 i8 i4") if places.is_valid else factors(None, width)
                change = np.zeros(len(split) + 1, np.int64)
                np.add.at(change, parsed[0], 1)
                np.add.at(change, parsed[0] + parsed[1], -1)
                kept = np.cumsum(change[:-1]) == 0
                body = b" ".join(compress(split, kept.tolist())).decode()
                out.append((doc, len(split), int(len(split) - kept.sum()), parsed, body))
                held += len(body) + 32 * len(parsed[0])
                if held >= BATCH_BYTES:
                    yield _parsed(out)
                    out, held = [], 0
        yield _parsed(out)

    def known(rows: DataFrame, name: str, types: str, made) -> DataFrame:
        """What the blocks know of each document, as a saved table."""
        gathered = work.save(dealt(rows).mapInArrow(_gathered(types, made), _GATHERED), name)
        return broadcast_if_small(gathered, "length(places) + 24", 1)

    shared = dealt(texts.mapInArrow(find_anchors, _SCHEMA)).mapInArrow(_looked_up(parts, "u8 i8 i8 i4 i1", _shared_anchors), _SCHEMA)
    affected = texts.join(known(shared, "anchors", "i8 i8 i4", _steps), ["doc", "piece"]).select("doc", "piece", "text", "places")
    later = dealt(affected.mapInArrow(find_windows, _SCHEMA)).mapInArrow(_looked_up(parts, "u8 i8 i8 i4", _later_windows), _SCHEMA)
    parsed_by_doc = known(later, "factors", "i8 i8 i4 i8 i4", lambda places: _body(factors(places, width)))
    work.drop("anchors")
    parsed = texts.join(parsed_by_doc, ["doc", "piece"], "left").select("doc", "text", "places").mapInArrow(parse, _PARSED)
    return parsed.withColumn("doc", F.when(F.col("doc") != int(LAST), F.col("doc"))).withColumnRenamed("doc", id_col)


_FACTOR = ("start", "length", "ref_doc", "ref_start")
_PARSED = "doc long, n_words long, n_removed long, factors array<struct<start: int, length: int, ref_doc: long, ref_start: int>>, kept_text string"


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    doc, words, removed, parsed, kept = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
    ends = np.cumsum([0, *(len(f[0]) for f in parsed)]).astype(np.int32)
    flat = [np.concatenate(c) for c in zip(*(parsed or [factors(None, WIDTH)]), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat], _FACTOR))
    columns = [*(pa.array(c, pa.int64()) for c in (doc, words, removed)), lists, pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "factors", "kept_text"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, and the digest of the others."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op5_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS k FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r WHERE n > 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
k AS (SELECT a.doc_id, count(*) FILTER (c.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY a.p) FILTER (c.p IS NULL), '') AS kept
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
}
