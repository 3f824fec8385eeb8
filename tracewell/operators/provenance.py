"""Where text came from: the window index, containment, influence, kinship."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Owners kept for a window; windows that two sources must share to be kin; characters of an overlap.
OWNERS, KIN_WINDOWS, OVERLAP = 4, 3, 32
#: Characters of a value in which spans meet; rows of windows that are broadcast, some 24 MB.
TILE, FEW = 256, 250_000


def window_rows(docs: DataFrame, text: Column, step: int) -> DataFrame:
    """``docs`` without the text, a row for each window: at and window.

    Two generators: blocks first, then the windows of a block.
    """
    keys = [c for c in docs.columns]
    cut = docs.select(*keys, F.explode(T.blocks(text, step)).alias("_block"))
    return cut.select(*keys, F.inline(T.windows(F.col("_block"), step)))


def in_few(rows: DataFrame, keys: DataFrame, most: int = FEW) -> DataFrame:
    """``rows`` whose window is in ``keys``: before any shuffle of ``rows`` where
    ``keys`` are counted to be ``most`` or fewer, by a shuffled join beyond."""
    keys = keys.select("window").distinct()
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, "window", "left_semi")


def window_index(sources: DataFrame, owners: int | None = OWNERS, only: DataFrame | None = None) -> DataFrame:
    """(window, source_id, seq) of distinct windows with the first ``owners`` of each.

    ``sources`` has source_id, seq (order of arrival) and text; where it has
    trusted, those rows are not indexed.  Distinct rows are aggregated before
    they move.  With ``only`` (a table of windows) just
    those are indexed; owners are per window, so they are the same.
    """
    if "trusted" in sources.columns:
        sources = sources.filter(~F.col("trusted"))
    normal = sources.select("source_id", "seq", T.normalize(F.col("text")).alias("_normal"))
    rows = window_rows(normal.filter(F.length("_normal") >= T.WINDOW), F.col("_normal"), T.STEP)
    if only is not None:
        rows = in_few(rows, only)
    found = rows.groupBy("window", "source_id").agg(F.min("seq").alias("seq"))
    if owners is None:
        return found
    first = Window.partitionBy("window").orderBy("seq", "source_id")
    return found.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= owners).drop("_rank")


def atom_index(sources: DataFrame) -> DataFrame:
    """(atom, source_id): the first source of each identity token."""
    rows = sources.select("source_id", "seq", F.explode(T.atoms(F.col("text"))).alias("atom"))
    return rows.groupBy("atom").agg(F.min_by("source_id", F.struct("seq", "source_id")).alias("source_id"), F.min("seq").alias("seq"))


def probe_rows(values: DataFrame) -> DataFrame:
    """A row for each window of a value at every offset: value_id, (seq,) at, window."""
    keys = [c for c in ("value_id", "seq") if c in values.columns]
    normal = values.select(*keys, T.normalize(F.col("text")).alias("_normal"))
    return window_rows(normal.filter(F.length("_normal") >= T.WINDOW), F.col("_normal"), 1).drop("_normal")


def contained(values: DataFrame, index: DataFrame) -> DataFrame:
    """(value_id, source_id, at) for each window of a value that a source has.

    An equi-join on the window; with columns seq on both sides, a value meets
    only what was indexed before it.
    """
    has_seq = "seq" in values.columns
    probes = probe_rows(values)
    joined = probes.withColumnRenamed("seq", "_at_seq").join(index, "window") if has_seq else probes.join(index.drop("seq"), "window")
    return (joined.filter("seq < _at_seq") if has_seq else joined).select("value_id", "source_id", "at")


def merged_spans(hits: DataFrame, keys: list[str], width: int = T.WINDOW) -> DataFrame:
    """Touching spans of ``width`` from ``at`` merged: keys, start and end."""
    order = Window.partitionBy(*keys).orderBy("at")
    starts = hits.select(*keys, "at").distinct().withColumn("_new", F.coalesce((F.col("at") > F.lag("at").over(order) + width).cast("int"), F.lit(1)))
    islands = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("at").alias("start"), (F.max("at") + width).alias("end")).drop("_island")


def influence(spans: DataFrame) -> DataFrame:
    """Fragments of each source in each value."""
    return spans.groupBy("value_id", "source_id").agg(F.count("*").alias("fragments"), F.sum(F.col("end") - F.col("start")).alias("covered"))


def top_influences(influences: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` largest influences of a value, and how many more there are."""
    order = Window.partitionBy("value_id").orderBy(F.desc("fragments"), "source_id")
    all_of = Window.partitionBy("value_id")
    ranked = influences.withColumns({"rank": F.row_number().over(order), "_all": F.count("*").over(all_of)})
    return ranked.filter(F.col("rank") <= most).withColumn("more", F.greatest(F.col("_all") - most, F.lit(0))).drop("_all")


def overlaps(spans: DataFrame, least: int = OVERLAP) -> DataFrame:
    """The first stretch of ``least`` characters that two sources share in a value.

    Spans meet in the tiles of a value that they cover, and a pair counts in the
    tile where its stretch begins, so spans far from each other never meet.
    """
    tiles = F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE))
    tiled = spans.select("value_id", "source_id", "start", "end", F.explode(tiles).alias("tile"))
    a, b = tiled.alias("a"), tiled.alias("b")
    first = F.greatest("a.start", "b.start")
    here = (F.least("a.end", "b.end") - first >= least) & (F.floor(first / TILE) == F.col("a.tile"))
    pairs = a.join(b, F.expr("a.value_id = b.value_id AND a.tile = b.tile AND a.source_id < b.source_id") & here)
    found = pairs.select("a.value_id", F.col("a.source_id").alias("left_id"), F.col("b.source_id").alias("right_id"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))
    return found.groupBy("value_id", "left_id", "right_id").agg(F.min(F.struct("start", "end")).alias("s")).select("value_id", "left_id", "right_id", "s.start", "s.end")


def kinship_pairs(index: DataFrame, least: int = KIN_WINDOWS) -> DataFrame:
    """Pairs of sources that share at least ``least`` windows.

    ``index`` must be capped by :func:`window_index`: a window then gives six
    pairs at most, however many sources hold it.
    """
    owned = index.groupBy("window").agg(F.sort_array(F.collect_set("source_id")).alias("owners")).filter(F.size("owners") > 1)
    left = owned.select(F.posexplode("owners").alias("_i", "left_id"), "owners")
    pairs = left.select("left_id", F.explode(F.slice("owners", F.col("_i") + 2, F.size("owners"))).alias("right_id"))
    return pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def checkpoint_dir(df: DataFrame) -> str:
    """The folder named in spark.checkpoint.dir, or one of this machine's where
    the session runs on it alone."""
    import tempfile

    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tracewell-")


def groups(pairs: DataFrame) -> DataFrame:
    """(source_id, group_id): connected sources, named by the least of them.

    Labels fall to the least neighbour's label and then to their label's own,
    so paths halve; every round is written out, which ends its lineage.
    """
    root = f"{checkpoint_dir(pairs)}/groups-{uuid.uuid4().hex}"
    spark = pairs.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    both = saved(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).unionAll(pairs.select("right_id", "left_id")), "links")
    labels = saved(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_low"))
        jumped = low.join(labels.select(F.col("node").alias("_low"), F.col("label").alias("_next")), "_low", "left")
        k += 1
        labels = saved(jumped.select("node", F.least("_low", F.coalesce("_next", "_low")).alias("label"), F.col("label").alias("before")), f"labels-{k}")
        if labels.filter("label <> before").isEmpty():
            return labels.select(F.col("node").alias("source_id"), F.col("label").alias("group_id"))
        labels = labels.drop("before")
