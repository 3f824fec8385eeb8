"""Near-duplicate vectors by NN-descent.

Equal vectors are one node from the start.  The first neighbour lists come from
tables of random hyperplanes.  Each round then joins, at every node, its
neighbours and those it is a neighbour of, scores them against each other, and
keeps the best of each list; rounds end when few entries change.  The number of
tables grows with their bits, so that two nodes at the threshold meet with the
same probability however many nodes there are.  Links of at least the threshold are then computed exactly in double precision.

A node whose list holds nothing but links is saturated: it may have more than
the list can hold.  A link that no list holds has two saturated ends, so the
saturated nodes are compared again, in tables of their own, with those of other
components, and components that meet are joined.  Then the lists of every
component of three nodes or more are enlarged to the whole component, whose
nodes are compared block by block with exact cosines; only counts leave the
blocks, no pairs.  So lists bound the search, and never what is counted.

Lists start from tables, and nodes of a table's bucket above ``BUCKET`` are
dealt by hash into parts, so no bucket is read as a whole by a task.

Defined results: a vector that is null, all zero or holds a null or non-finite
component links with nothing; vectors of different lengths do not link;
repeated ids are one row each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.workspace import BROADCAST_BYTES, Workspace, broadcast_if_small

THRESHOLD = 0.95
#: Neighbours in a list; tables of hyperplanes at least, and those shuffled at once; share of changed entries that ends the rounds.
LIST, TABLES, AT_ONCE, DONE = 8, 8, 10, 0.01
#: Probability that two nodes at the threshold meet in a table.
MEET = 0.99
#: Nodes compared at once, and the size that a table's buckets are made for.
BUCKET, BUCKET_WANTED, BLOCK = 1024, 48, 512
#: Scores of the search are from rounded components; what is near enough is computed exactly.
SLACK = 0.02


def usable(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and vectors as doubles, of the vectors that can link."""
    v = F.col(vector_col).cast("array<double>")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return docs.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.coalesce(real, F.lit(False)))


def _units(bodies: pa.Array) -> np.ndarray:
    """Unit vectors of stored components; all have one length."""
    rows = np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in bodies])
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of one group at a time, sorted by the first ``keys`` columns; rows of
    a group beyond ``most`` come as a further group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(marks)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield _whole(held)
                held = []
            while part.num_rows and sum(h.num_rows for h in held) + part.num_rows >= most:
                take = most - sum(h.num_rows for h in held)
                yield _whole([*held, part.slice(0, take)])
                held, part = [], part.slice(take)
            if part.num_rows:
                held.append(part)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def _best(scores: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of the best ``size`` others in each row of ``scores``."""
    np.fill_diagonal(scores, -2)
    size = min(size, len(ids) - 1)
    top = np.argpartition(-scores, size - 1, axis=1)[:, :size] if size < len(ids) - 1 else np.argsort(-scores, axis=1)[:, :size]
    rows = np.repeat(np.arange(len(ids)), size)
    return ids[rows], ids[top.ravel()], scores[rows, top.ravel()].astype(np.float32)


_EDGE = "a long, b long, score float"


def _edges(columns: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float32())], ["a", "b", "score"])


def _in_lots(found: Iterator[tuple[np.ndarray, ...]], lot: int = 200_000) -> Iterator[pa.RecordBatch]:
    columns, rows = [], 0
    for c in found:
        columns.append(c)
        rows += len(c[0])
        if rows >= lot:
            yield _edges(columns)
            columns, rows = [], 0
    yield _edges(columns)


def _kept(edges: DataFrame, size: int) -> DataFrame:
    """The best ``size`` different neighbours of each node."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen = None, 0
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i, x in enumerate(a.tolist()):
                if x != node:
                    node, seen = x, 0
                if seen < size:
                    keep[i] = True
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(c.to_numpy()[keep]) for c in batch.columns], ["a", "b", "score"])

    best = edges.groupBy("a", "b").agg(F.max("score").alias("score"))
    return best.repartition("a").sortWithinPartitions("a", F.desc("score"), "b").mapInArrow(cut, _EDGE)


def _bits(count: int) -> int:
    return max(1, round(math.log2(max(2, count / BUCKET_WANTED))))


def _tables_for(bits: int, threshold: float) -> int:
    """Tables in which two nodes at ``threshold`` meet with probability :data:`MEET`."""
    alike = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return TABLES if not 0 < alike < 1 else max(TABLES, math.ceil(math.log(1 - MEET) / math.log(1 - alike)))


def _table_keys(q: np.ndarray, bits: int, tables: range) -> np.ndarray:
    """The bucket of each row in each of ``tables``."""
    planes = np.stack([np.random.default_rng((17, k)).standard_normal((q.shape[1], bits)) for k in tables], 1)
    signs = (q @ planes.reshape(q.shape[1], -1) > 0).reshape(len(q), len(tables), bits)
    return (signs << np.arange(bits)).sum(2) + (np.array(tables, np.int64) << 40)


def _first_lists(nodes: DataFrame, count: int, threshold: float, work: Workspace, name: str) -> DataFrame:
    """The best neighbours of each node from all tables, some tables at a time."""
    bits, graph = _bits(count), None
    wanted = _tables_for(bits, threshold)
    lots = math.ceil(wanted / AT_ONCE)
    for k in range(lots):
        tables = range(k * wanted // lots, (k + 1) * wanted // lots)
        edges = _tables(nodes, bits, tables, Workspace(nodes.sparkSession, "neighbours-tables"))
        last, graph = graph, work.save(_kept(edges if graph is None else graph.unionAll(edges), LIST), f"{name}-tables-{k}")
        if last is not None:
            work.drop(f"{name}-tables-{k - 1}")
    return graph


def _tables(nodes: DataFrame, bits: int, tables: range, work: Workspace) -> DataFrame:
    """Edges from tables of random hyperplanes."""

    def hashed(with_vector: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = _table_keys(_quantised(batch.column(1)), bits, tables)
                repeat = np.repeat(np.arange(len(keys)), len(tables))
                columns = [pa.array(keys.ravel()), batch.column(0).take(pa.array(repeat))]
                if with_vector:
                    columns.append(batch.column(1).take(pa.array(repeat)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "q"][: len(columns)])

        return run

    source = nodes.select("id", "q")
    large = source.mapInArrow(hashed(False), "key long, id long").groupBy("key").count().filter(f"count > {BUCKET}")
    large = work.save(large.select("key", F.ceil(F.col("count") / (BUCKET // 2)).alias("parts")), "large")
    keyed = source.mapInArrow(hashed(True), "key long, id long, q binary").join(broadcast_if_small(large, "2", 16), "key", "left")
    dealt = keyed.select("key", F.pmod(F.xxhash64("id", "key"), F.coalesce("parts", F.lit(1))).alias("deal"), "id", "q")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for group in _groups(batches, 2, 2 * BUCKET):
                if group.num_rows > 1:
                    q = _quantised(group.column(3))
                    yield _best(q @ q.T, group.column(2).to_numpy(), LIST)

        return _in_lots(each())

    return dealt.repartition("key", "deal").sortWithinPartitions("key", "deal", "id").mapInArrow(scored, _EDGE)


def _quantised(bodies: pa.Array) -> np.ndarray:
    rows = np.stack([np.frombuffer(b.as_buffer(), np.int8) for b in bodies]).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _round(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges better than the worst of their list, from neighbours of neighbours."""
    worst = graph.groupBy("a").agg(F.min("score").alias("worst"), F.count("*").alias("many"))
    both = graph.select(F.col("a").alias("at"), F.col("b").alias("id"), "score").unionAll(graph.select(F.col("b").alias("at"), F.col("a").alias("id"), "score"))
    member = both.groupBy("at", "id").agg(F.max("score").alias("score"))
    filled = nodes.select("id", "q").join(worst.select(F.col("a").alias("id"), F.when(F.col("many") >= LIST, F.col("worst")).otherwise(-1.0).cast("float").alias("worst")), "id", "left")
    joined = member.join(filled, "id").select("at", "score", "id", F.coalesce("worst", F.lit(-1.0)).cast("float").alias("worst"), "q")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for group in _groups(batches, 1, BUCKET):
                if group.num_rows < 2:
                    continue
                ids, worst, q = group.column(2).to_numpy(), group.column(3).to_numpy(), _quantised(group.column(4))
                a, b, s = _best(q @ q.T, ids, LIST)
                better = s > np.repeat(worst, len(a) // len(ids))
                yield a[better], b[better], s[better]

        return _in_lots(each())

    return joined.repartition("at").sortWithinPartitions("at", F.desc("score"), "id").mapInArrow(local, _EDGE)


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at least ``threshold``."""
    left, right = (nodes.select(F.col("id").alias(c), F.col("body").alias(f"v{c}")) for c in "ab")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.einsum("ij,ij->i", _units(batch.column(2)), _units(batch.column(3))) >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[near]) for k in (0, 1)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(cosine, "a long, b long")


def _saturated(graph: DataFrame, threshold: float) -> DataFrame:
    """Nodes whose full list may hold nothing but links."""
    return graph.groupBy("a").agg(F.min("score").alias("worst"), F.count("*").alias("many")).filter((F.col("many") >= LIST) & (F.col("worst") >= threshold - SLACK)).select(F.col("a").alias("id"))


def _across(full: DataFrame, nodes: DataFrame, roots: DataFrame, count: int, threshold: float, work: Workspace) -> DataFrame:
    """Links between components (a and b are roots) from saturated nodes, those
    of a bucket with several components compared block by block."""
    bits = _bits(count)
    tables = range(_tables_for(bits, threshold))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _table_keys(_quantised(batch.column(2)), bits, tables)
                repeat = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(repeat), batch.column(1).take(repeat)], ["key", "id", "root"])

    rooted = full.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(nodes.select("id", "q"), "id")
    source = rooted.select("id", F.coalesce("root", "id").alias("root"), "q")
    keyed = work.save(source.mapInArrow(hashed, "key long, id long, root long"), "keyed")
    mixed = keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "blocks")
    placed = keyed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    vectors = placed.join(nodes.select("id", "body"), "id")
    met = vectors.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "block", "root", "body")
    tasks = met.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "root", "body")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3, 1 << 20):
            block, root = group.column(3).to_numpy(), group.column(4).to_numpy()
            unit = _units(group.column(5))
            first, second = np.flatnonzero(block == group.column(1)[0].as_py()), np.flatnonzero(block == group.column(2)[0].as_py())
            i, j = np.nonzero((unit[first] @ unit[second].T >= threshold) & (root[first][:, None] != root[second]))
            pairs = np.unique(np.sort(np.stack([root[first][i], root[second][j]], 1), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = tasks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "root")
    return dealt.mapInArrow(compared, "a long, b long").distinct()


def _completed(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): for nodes of components of three or more, the rows at the
    threshold, from comparing a component block by block."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    vectors = placed.join(nodes.select(F.col("id").alias("node"), "many", "body"), "node")
    # a block meets itself and every other once: two sides of a square, as many as blocks
    met = vectors.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "block", "node", "many", "body")
    tasks = met.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "many", "body")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3, 1 << 20):
            block, node, many = (group.column(k).to_numpy() for k in (3, 4, 5))
            x, y = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            unit = _units(group.column(6))
            first, second = np.flatnonzero(block == x), np.flatnonzero(block == y)
            near = unit[first] @ unit[second].T >= threshold
            if x == y:
                np.fill_diagonal(near, False)
                ids, linked = node[first], near @ many[second]
            else:
                ids, linked = np.concatenate([node[first], node[second]]), np.concatenate([near @ many[second], near.T @ many[first]])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.astype(np.int64))], ["id", "linked"])

    dealt = tasks.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "block", "node")
    return dealt.mapInArrow(compared, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row: vec_id, n_links, component_id and kept."""
    work = Workspace(rows.sparkSession, "neighbours")
    real = usable(rows, id_col, vector_col)
    classes = real.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v.as_py(), np.float64) for v in batch.column(0)]
            scaled = [np.rint(v / np.abs(v).max() * 127).astype(np.int8).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(scaled, pa.binary())],
                ["v", "id", "many", "length", "body", "q"],
            )

    nodes = work.save(classes.mapInArrow(stored, "v array<double>, id long, many long, length int, body binary, q binary"), "nodes")
    found, saturated = [], []
    lengths = [(r["length"], r["count"]) for r in nodes.groupBy("length").count().collect()]
    for length, count in sorted(lengths):
        of = nodes.filter(F.col("length") == length)
        graph, k, changed = _first_lists(of, count, threshold, work, f"graph-{length}"), 0, count * LIST
        while changed and changed >= DONE * LIST * count:
            k += 1
            better = work.save(_kept(graph.unionAll(_round(graph, of)), LIST), f"graph-{length}-{k}")
            changed = better.join(graph.select("a", "b"), ["a", "b"], "left_anti").count()
            if k > 1:
                work.drop(f"graph-{length}-{k - 1}")
            graph = better
        near = graph.filter(F.col("score") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found.append(work.save(_exact(near, of, threshold), f"links-{length}"))
        full = work.save(_saturated(graph, threshold), f"full-{length}")
        if many := full.count():
            saturated.append((length, many, full))
    links = found[0] if found else work.spark.createDataFrame([], "a long, b long")
    for more in found[1:]:
        links = links.unionAll(more)
    roots = components(links, work)
    if saturated:
        joined = links
        for length, many, full in saturated:
            across = Workspace(rows.sparkSession, "neighbours-across")
            joined = joined.unionAll(across.save(_across(full, nodes.filter(F.col("length") == length), roots, many, threshold, across), "joined"))
        roots = components(joined, Workspace(rows.sparkSession, "neighbours-joined"))
    sized = work.save(roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").join(nodes.select(F.col("id").alias("node"), "many"), "node"), "sized")
    small = sized.filter("size = 2").alias("s").join(sized.filter("size = 2").alias("t"), F.expr("s.root = t.root AND s.node <> t.node")).select(F.col("s.node").alias("id"), F.col("t.many").alias("linked"))
    large = _completed(sized.filter("size > 2").select("node", "root"), nodes, threshold)
    least = sized.groupBy("root").agg(F.min("node").alias("component_id"))
    linked = work.save(
        sized.select(F.col("node").alias("id"), "root").join(least, "root").join(small.unionAll(large), "id", "left").select("id", "component_id", F.coalesce("linked", F.lit(0)).alias("linked")),
        "linked",
    )
    of_class = nodes.select("v", "id", "many").join(linked, "id", "left").select(
        "v", F.coalesce("component_id", "id").alias("component_id"), (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    every = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    joined = every.join(of_class, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def audited(rows: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, threshold: float = THRESHOLD) -> DataFrame:
    """For each row whose id is divisible by ``every``: its links by brute force
    against all rows (expected) and those found, to measure recall by.

    The rows asked for are measured, and dealt by hash into blocks that may be
    broadcast; every block meets all rows.
    """
    asked = rows.filter(F.col(id_col) % every == 0)
    real = usable(asked, id_col, vector_col).select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x))
    held = real.agg(F.sum(F.size("qv") + 4)).first()[0] or 0
    blocks = max(1, math.ceil(held * 8 / BROADCAST_BYTES))
    parts = []
    for k in range(blocks):
        block = real.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == k)
        against = usable(rows, id_col, vector_col).join(F.broadcast(block), F.expr("q_id <> vec_id AND size(qv) = size(v)"))
        parts.append(against.filter(dot / (size("qv") * size("v")) >= threshold).groupBy("q_id").agg(F.count("*").alias("expected")))
    expected = parts[0]
    for part in parts[1:]:
        expected = expected.unionAll(part)
    return expected.join(found.select(F.col("vec_id").alias("q_id"), F.col("n_links").alias("found")), "q_id")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op10_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
}
