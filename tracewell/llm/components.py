"""Connected components of a graph kept as a table of links.

Every round, each node points at the neighbour (or itself) that a random order
puts first, links are moved to what their ends point at, and links within one
node go.  A random order makes the expected number of rounds logarithmic
whatever the graph looks like; hubs are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.workspace import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a and b, longs).

    Nodes of one component share a root, which is one of them.
    """
    links = work.save(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-0")
    roots = work.save(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots-0")
    k = 0
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(order("b")).alias("_b")).select(F.col("a").alias("node"), F.least("_b", order("a"))["n"].alias("to"))
        first = work.save(first, f"first-{k}")
        moved = (
            links.join(first.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(first.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        rooted = roots.join(first.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        links, roots = work.save(moved, f"links-{k + 1}"), work.save(rooted, f"roots-{k + 1}")
        for name in (f"links-{k}", f"roots-{k}", f"first-{k}"):
            work.drop(name)
        k += 1
    return roots
