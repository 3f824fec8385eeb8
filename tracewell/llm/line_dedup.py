"""Line dedup: which lines of which documents go, as bitmaps.

Lines are hashed, range-partitioned by hash and sorted by hash, document and
position; each partition streams its runs of equal hashes.  A run in fewer than
``min_docs`` documents is left alone.  Of any other run every line goes, or
with ``keep_first`` every line but the first occurrence.

Before the shuffle each task looks over its own lines: a hash that it alone
finds in enough documents is decided there.  Those lines travel with their
document, not their hash, and a single mark tells the run; so no run gets more
than a few rows from each task, however common its line is.

Defined results: a null or empty text is one empty line; a line whose key is
shorter than ``min_chars`` never goes; null ids are one document, after all
others; rows alike in id and text get the same bitmap; rows that repeat an id
count once in ``min_docs``; the lines of a very long text are hashed in lots of
bounded size, its bitmap is a bit for each; columns named like a result are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.workspace import Aside, Workspace, broadcast_if_small, read_documents

#: Lines that a task looks over at once.
BUFFER_LINES = 200_000
LAST = np.iinfo(np.int64).max
MARK, OPEN, DECIDED = 0, 1, 2
_COLUMNS = ["part", "key", "kind", "doc", "pos", "row"]
_SCHEMA = "part int, key long, kind int, doc long, pos int, row long"


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _ranged(keys: np.ndarray, parts: int) -> np.ndarray:
    """The number of each key's range when all keys are cut into equal ranges."""
    high = (keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(40)
    return (high * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


def line_keys(text: str, min_chars: int) -> list[int | None]:
    """The hash of each line's key; None where the key is too short."""
    found: list[int | None] = []
    for line in text.encode().split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars)
        found.append(xxhash.xxh64_intdigest(key, 0) if long else None)
    return found


def _look_over(key, doc, pos, row, parts: int, min_docs: int, keep_first: bool) -> pa.RecordBatch:
    """The rows of one buffer, with what it decides by itself."""
    order = np.lexsort((pos, doc, key))
    key, doc, pos, row = key[order], doc[order], pos[order], row[order]
    starts = np.flatnonzero(_changes(key))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    docs = np.bincount(run, weights=_changes(key, doc), minlength=len(starts))
    hot = docs >= min_docs
    kind = np.where(hot[run], DECIDED, OPEN).astype(np.int32)
    if keep_first:
        kind[starts] = OPEN
    marks = key[starts[hot]]
    part = np.where(kind == DECIDED, _ranged(_mixed(doc), parts), _ranged(key, parts))
    nothing = np.zeros(len(marks), np.int64)
    columns = [
        np.concatenate([part, _ranged(marks, parts)]),
        np.concatenate([key, marks]),
        np.concatenate([kind, np.full(len(marks), MARK, np.int32)]),
        np.concatenate([doc, nothing]),
        np.concatenate([pos, nothing.astype(np.int32)]),
        np.concatenate([row, nothing]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _COLUMNS)


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows to drop from sorted rows; only an undecided run is held over."""
    held = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int64)]
    known = None  # a key that is over the limit already and whose first occurrence is past

    def settle(rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
        nonlocal held, known
        key, kind, doc, pos, row = rows
        free = kind == DECIDED
        mine = [c[~free] for c in rows]
        gone = [(row[free], pos[free])]
        key, kind, doc, pos, row = mine
        starts = np.flatnonzero(_changes(key))
        sizes = np.diff(np.append(starts, len(key)))
        run = np.repeat(np.arange(len(starts)), sizes)
        real = kind != MARK
        docs = np.bincount(run, weights=_changes(key, doc) & real, minlength=len(starts))
        over = (docs >= min_docs) | (np.bincount(run, weights=~real, minlength=len(starts)) > 0)
        continued = len(key) > 0 and known is not None and key[0] == known
        if continued:
            over[0] = True
        drop = over[run] & real
        if keep_first and len(key):
            first = np.full(len(starts), -1)
            where = np.flatnonzero(real)[::-1]
            first[run[where]] = where
            spared = first[1 if continued else 0 :]
            drop[spared[spared >= 0]] = False
        held = [c[:0] for c in mine]
        if not last and len(key):
            tail = starts[-1]
            if over[-1] and real[tail:].any():
                known = key[-1]
            else:  # not decided: wait for the rest of the run
                held = [c[tail:] for c in mine]
                drop[tail:] = False
        gone.append((row[drop], pos[drop]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*gone, strict=True)], ["row", "pos"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, ("key", "kind", "doc", "pos", "row"), strict=True)]
        yield settle(rows, False)
    yield settle(held, True)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(row, pos): the key of a row of ``docs`` and the position of a line that goes.

    ``docs`` should be read from a table, as the pipeline's stages are: what a
    task decides by itself depends on the order of its rows, and a second
    attempt must see the same.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("doc"),
        row_key(docs, id_col, text_col).alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, pos, row, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            return _look_over(*(np.concatenate(c) for c in (key, doc, pos, row)), parts, min_docs, keep_first)

        for batch in batches:
            for d, r, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                keys = line_keys(text.as_py(), min_chars)
                at = np.array([i for i, x in enumerate(keys) if x is not None], np.int32)
                key.append(np.array([x for x in keys if x is not None], np.uint64).view(np.int64))
                pos.append(at)
                doc.append(np.full(len(at), d.as_py(), np.int64))
                row.append(np.full(len(at), r.as_py(), np.int64))
                held += len(at)
                if held >= BUFFER_LINES:
                    yield flush()
                    key, doc, pos, row, held = [], [], [], [], 0
        if held:
            yield flush()

    shuffled = rows.mapInArrow(hashed, _SCHEMA).repartitionById(parts, F.col("part")).drop("part")
    ordered = shuffled.sortWithinPartitions("key", "kind", "doc", "pos", "row")
    return ordered.mapInArrow(lambda batches: _stream(batches, min_docs, keep_first), "row long, pos int")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(row, n_dropped, keep) for each row of ``docs`` that loses a line.

    ``row`` is :func:`row_key`; ``keep`` is a compressed bitmap, a bit for each
    line; lines past its end stay.
    """

    @F.arrow_udf("binary")
    def bitmap(positions: pa.Array) -> pa.Array:
        found = []
        for p in positions:
            keep = np.ones(max(p.as_py()) // 8 * 8 + 8, bool)
            keep[p.as_py()] = False
            found.append(zlib.compress(np.packbits(keep).tobytes()))
        return pa.array(found, pa.binary())

    gone = dropped_lines(docs, id_col, text_col, min_docs, min_chars, keep_first)
    each = gone.groupBy("row").agg(F.collect_set("pos").alias("gone"))
    return each.select("row", F.size("gone").cast("long").alias("n_dropped"), bitmap("gone").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """``text`` without the lines that a bitmap of :func:`keep_bitmaps` drops."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        found = []
        for text, keep in zip(texts, bitmaps, strict=True):
            if not keep.is_valid:
                found.append(text.as_py())
                continue
            lines = (text.as_py() or "").split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8)).tolist()
            bits = (bits + [1] * len(lines))[: len(lines)]
            found.append("\n".join(line for line, bit in zip(lines, bits, strict=True) if bit))
        return pa.array(found, pa.string())

    return cut(text, keep)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep (the bitmap, null: all stay) and
    kept_text."""
    work = Workspace(docs.sparkSession, "lines")
    aside = Aside(docs, "n_lines", "n_dropped", "keep", "kept_text")
    id_col, text_col = aside(id_col), aside(text_col)
    bitmaps = work.save(keep_bitmaps(aside.docs, id_col, text_col, **limits), "bitmaps")
    joined = aside.docs.withColumn("_tw_row", F.xxhash64(id_col, text_col)).join(
        broadcast_if_small(bitmaps.withColumnRenamed("row", "_tw_row"), "length(keep) + 48", 1), "_tw_row", "left"
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    return joined.select(
        *aside.back,
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        kept_text(text, F.col("keep")).alias("kept_text"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped, and the digest of what stays."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the lines that go."""
    aside = Aside(docs)
    found = line_dedup(aside.docs, aside("doc_id"), aside("text"))
    return found.withColumn(aside("text"), F.col("kept_text")).select(*aside.back)


SQL = {
    "op8_line_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM t),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
d AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY 1
"""
}
