"""SimHash near-duplicates, found through fuzzy Golay-code keys.

A fingerprint has 64 bits: a bit is set if it is set in over half the XXH64
hashes of the document's word shingles.  Two fingerprints within three bits are
cut into three segments.  Either one segment is equal and another differs in
one bit at most, or each differs in exactly one.  Segments one bit apart share
a codeword index once one side lists the indices of its neighbourhood, so these
keys find every pair:

* for each ordered choice of two segments, the bits of the first with each
  nearby index of the second;
* the three indices, with the first two or the last taken from the
  neighbourhood.

Equal fingerprints are one node from the start, so copies are never paired.
Within a key, fingerprints are checked bit by bit and joined to a spanning
forest: a group of n near copies gives n - 1 links there, not n squared.  A key
of more than :data:`LARGE` fingerprints is not read as a whole: its rows are
dealt again by the key and a quarter of the fingerprint, since two within three
bits are equal in one of four quarters.

:func:`similar_documents` verifies each link by the similarity of the sets of
shingles.  Three bits of five-word fingerprints hold only the nearest of the
pairs at similarity 0.8, whose expected distance is ten bits, and more bits than
three would take some thousand fuzzy keys a document.  So there the keys'
components are buckets beside those of MinHash bands, and both are verified.

Defined results: a null text has no words, and texts without words share the
fingerprint zero and are linked; fewer words than a shingle are one shingle;
rows with a null id belong to their component but never name it unless it has
no other id; repeated rows get the same result each; a very long text is hashed
part by part; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import golay
from tracewell.llm.components import components
from tracewell.llm.near_copies import bands_of, forest, similar
from tracewell.llm.workspace import Workspace, broadcast_if_small, own_name, read_documents

#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 3
#: A key with more fingerprints is dealt again by equal quarters of the fingerprint.
LARGE = 2048
#: Words of a shingle where similarity is verified, and shingles hashed at once.
SIMILAR_WIDTH, PART = 5, 1 << 16
#: Sets of a bucket that are compared with as many others in one task.
BLOCK = 256
LINK, DEALT_AGAIN = 0, 1


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles of a text, repeats included, in parts."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), PART):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + PART].tolist(), last[at : at + PART].tolist())], np.uint64)  # noqa: B905


def _print_of(parts: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    """The signed 64-bit fingerprint of shingle hashes; zero for none."""
    set_bits, shingles = np.zeros(64, np.int64), 0
    for hashes in parts:
        shingles += len(hashes)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > shingles, bitorder="little").view("<i8")[0])


def fingerprint_of(text: str, width: int) -> int:
    """The signed 64-bit fingerprint of one text."""
    return _print_of(shingle_hashes(text, width))


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint of ``text`` as a long."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(x.as_py() or "", width) for x in batch], pa.int64())

    return simhash(text)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the position of the fingerprint that each belongs to."""
    bits = prints.view(np.uint64)
    parts = [(bits >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.uint32) for low, n in SEGMENTS]
    near = [golay.nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    keys, owners = [], []
    for case, (exact, fuzzy) in enumerate(permutations(range(3), 2)):
        found, mask = near[fuzzy]
        row, column = np.nonzero(mask)
        keys.append(np.int64(case) << 60 | parts[exact][row].astype(np.int64) << 12 | found[row, column].astype(np.int64))
        owners.append(row)
    own = [found[:, 0].astype(np.int64) for found, _ in near]
    (f0, m0), (f1, m1), (f2, m2) = near
    # first two from the neighbourhood, third its own
    row, c0, c1 = np.nonzero(m0[:, :, None] & m1[:, None, :])
    keys.append(np.int64(6) << 60 | f0[row, c0].astype(np.int64) << 24 | f1[row, c1].astype(np.int64) << 12 | own[2][row])
    owners.append(row)
    # the first two its own, third from the neighbourhood; the third's own is there already
    m2 = m2.copy()
    m2[:, 0] = False
    row, c2 = np.nonzero(m2)
    keys.append(np.int64(6) << 60 | own[0][row] << 24 | own[1][row] << 12 | f2[row, c2].astype(np.int64))
    owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right, rest = [], [], prints
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= DISTANCE
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), at))
                right.append(new)
                reached.extend(new)
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def near_links(prints: DataFrame, work: Workspace) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (print)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                keys, owners = fuzzy_keys(values[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[at : at + 4096][owners])], ["key", "print"])

    def linked(most: int | None):
        return lambda batches: _linked(batches, most)

    schema = "kind int, a long, b long"
    found = prints.select("print").mapInArrow(keyed, "key long, print long")
    met = work.save(found.repartition("key").sortWithinPartitions("key").mapInArrow(linked(LARGE), schema), "met")
    again = met.filter(F.col("kind") == DEALT_AGAIN)
    quarters = [F.xxhash64("a", F.lit(k), F.shiftrightunsigned("b", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    dealt = again.select(F.explode(F.array(*quarters)).alias("key"), F.col("b").alias("print"))
    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(linked(None), schema)
    return met.filter(F.col("kind") == LINK).unionAll(more).select("a", "b").distinct()


def _linked(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Links within the keys of sorted rows (key, print); the rows of a key with
    more than ``most`` are handed on, and not held."""
    keys, values, over = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        new, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if over is not None:
            same = int(np.searchsorted(new, over, side="right"))
            yield _rows(DEALT_AGAIN, new[:same], prints[:same])
            new, prints = new[same:], prints[same:]
        if not len(new):
            continue
        over = None
        keys, values = np.concatenate([keys, new]), np.concatenate([values, prints])
        whole = np.searchsorted(keys, keys[-1])  # the last key may go on
        if whole:
            yield from _links_of(keys[:whole], values[:whole], most)
            keys, values = keys[whole:], values[whole:]
        if most is not None and len(keys) > most:
            yield _rows(DEALT_AGAIN, keys, values)
            over, keys, values = keys[-1], keys[:0], values[:0]
    if len(keys):
        yield from _links_of(keys, values, most)


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _links_of(keys: np.ndarray, values: np.ndarray, most: int | None) -> Iterator[pa.RecordBatch]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]
    near = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= DISTANCE
    left, right = [values[two][near]], [values[two + 1][near]]
    for k in np.flatnonzero(sizes > 2):
        if most is not None and sizes[k] > most:
            yield _rows(DEALT_AGAIN, keys[cuts[k] : cuts[k + 1]], values[cuts[k] : cuts[k + 1]])
            continue
        a, b = _forest(np.unique(values[cuts[k] : cuts[k + 1]]))
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    yield _rows(LINK, np.minimum(a, b), np.maximum(a, b))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """A row for each document: its id, fingerprint (long) and component_id."""
    work = Workspace(docs.sparkSession, "simhash")
    printed = docs.select(F.col(id_col), fingerprint(F.col(text_col), width).alias("fingerprint"))
    printed = work.save(printed, "prints")
    nodes = work.save(printed.groupBy(F.col("fingerprint").alias("print")).agg(F.min(id_col).alias("least")), "nodes")
    roots = components(near_links(nodes, work), work)
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select(F.col("print").alias("fingerprint"), "component_id")
    return printed.join(of, "fingerprint").select(id_col, "fingerprint", "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH) -> DataFrame:
    """A row for each document: its id, text_hash and the root of its component
    of documents whose shingles are similar (0.8 or more).

    Texts of the same shingles are one node; a text without words has none.
    """
    work = Workspace(docs.sparkSession, "similar")

    def printed_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                nodes, prints, bands = [], [], []
                for text in batch.column(2):
                    parts = list(shingle_hashes(text.as_py() or "", width))
                    shingles = _set_of(parts)
                    nodes.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                    prints.append(_print_of(parts))
                    bands.append(bands_of(shingles) if len(shingles) else [])
                columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_hash", "node", "print", "bands"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [_set_of(list(shingle_hashes(text.as_py() or "", width))).tobytes() for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    printed = work.save(source.mapInArrow(printed_of, f"id {kind}, text_hash long, node long, print long, bands array<long>"), "printed")
    spoken = printed.filter(F.size("bands") > 0)
    fuzzy = components(near_links(spoken.select("print").distinct(), work), Workspace(docs.sparkSession, "similar-prints")).select(F.col("node").alias("print"), "root")
    of_print = spoken.select("node", "print").distinct().join(fuzzy, "print", "left").select("node", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"))
    keyed = work.save(spoken.select("node", F.explode("bands").alias("key")).unionAll(of_print).distinct(), "keyed")
    # of buckets with the same members one is enough
    members = [F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]]
    buckets = keyed.groupBy("key").agg(*members).filter("n > 1").groupBy("n", "low", "high", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", "low")
    met = work.save(keyed.join(buckets, "key"), "met-sets")
    # only texts that share a bucket have their sets made, once for each set
    first = met.select("node").distinct().join(spoken.groupBy("node").agg(F.min("text_hash").alias("text_hash")), "node")
    shared = source.select("text_hash", "text").join(broadcast_if_small(work.save(first, "first"), "2", 8), "text_hash")
    sets = work.save(shared.dropDuplicates(["node"]).select("node", "text").mapInArrow(sets_of, "node long, shingles binary"), "sets")
    roots = components(_similar(met, sets, work), work).withColumnRenamed("node", "_node")
    rooted = printed.select("id", "text_hash", "node").join(roots, F.col("node") == F.col("_node"), "left")
    return rooted.select(F.col("id").alias(id_col), "text_hash", F.coalesce("root", "node").alias("root"))


def _set_of(parts: list[np.ndarray]) -> np.ndarray:
    """The different shingle hashes of a text in order."""
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _similar(met: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """Verified links (a, b) that join what similar sets of each bucket join:
    ``met`` has key, node, n (the bucket's size) and low (its least node).

    First every set is compared with that of its bucket's least node, row by row,
    however many they are.  What is not similar to it (the far ones) then meets
    the whole bucket, block by block.
    """
    least = met.filter("node = low").join(sets, "node").select("key", F.col("shingles").alias("least"))
    others = met.filter("node <> low").join(sets, "node").join(least, "key").select("key", "node", "low", "n", "shingles", "least")
    star = work.save(others.mapInArrow(_near_least, "key long, node long, low long, n long, near boolean"), "star")
    # of two sets both comparisons are one
    far = star.filter("NOT near AND n > 2").select("key", "node")
    blocks = far.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("far_blocks"))
    every = met.join(blocks, "key").withColumn("all_blocks", F.ceil(F.col("n") / BLOCK))
    place = lambda k, blocks: F.pmod(F.xxhash64("node", F.lit(k)), F.col(blocks))
    upto = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    one = every.join(far, ["key", "node"], "left_semi").select("key", place(1, "far_blocks").alias("x"), upto("all_blocks").alias("y"), "node")
    two = every.select("key", upto("far_blocks").alias("x"), place(2, "all_blocks").alias("y"), "node")
    tasks = one.unionAll(two).distinct().join(sets, "node").select("key", "x", "y", "node", "shingles")
    dealt = tasks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return star.filter("near").select(F.col("low").alias("a"), F.col("node").alias("b")).unionAll(dealt.mapInArrow(_alike, "a long, b long"))


def _near_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each set is similar to the least node's."""
    for batch in batches:
        pairs = zip(batch.column(4), batch.column(5), strict=True)
        near = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair)) for pair in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], ["key", "node", "low", "n", "near"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links within the blocks of sorted rows (key, x, y, node, shingles)."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
    for _, block in groupby(rows, lambda row: row[:3]):
        nodes, sets = zip(*((node, np.frombuffer(body, np.uint64)) for *_, node, body in block), strict=True)
        if len(nodes) > 1:
            a, b = forest(np.array(nodes, np.int64), list(sets))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = read_documents(spark, sf_dir)
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five words, similarity
    of 0.8 or more) the row of smallest id stays, a null id last.

    Rows alike in id and text are one document; which of them stays is open.
    """
    named = own_name(docs, "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    kept = similar_documents(docs).groupBy("root").agg(first).select(F.col("first.id").alias("kept_id"), F.col("first.hash").alias("kept_hash")).distinct().alias("kept")
    keyed = docs.withColumn(named, F.xxhash64("text")).alias("all")
    same = F.col("all.doc_id").eqNullSafe(F.col("kept.kept_id")) & (F.col(f"all.{named}") == F.col("kept.kept_hash"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", named]).drop(named)
