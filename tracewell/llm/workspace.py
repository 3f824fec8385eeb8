"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it again, so that a lost executor
costs its own tasks and never an earlier stage.  The folder is the one the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times their width that may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A session on one machine (``local[...]``) without the setting gets a
    temporary folder; a cluster without it is refused, since executors do not
    see each other's disks.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        import shutil

        _own[app] = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


class Workspace:
    """Tables of one operator call, each under its own name."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; its lineage ends here.

        The tables go when the driver ends, if not before.
        """
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        root, files = self._files(self.root)
        files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path, files = self._files(f"{self.root}/{name}")
        files.delete(path, True)


#: Bytes a core below which a table of texts is dealt out: it may be one row
#: group, which a single task would read.
SPREAD_BYTES = 4 * 1024 * 1024


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table that is small for the cores is dealt to all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SPREAD_BYTES else docs


def broadcast_if_small(table: DataFrame, width: str = "1", bytes_each: int = 16, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the saved ``table`` is measured as small.

    ``width`` is an SQL expression for the number of values in a row, and
    ``bytes_each`` the size of one.  Beyond ``limit`` the table is returned as
    it is and the join shuffles both sides.
    """
    total = table.agg(F.sum(F.expr(width).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(table) if total * bytes_each <= limit else table.hint("merge")


def quoted(name: str) -> str:
    """A column's name as it is written in an expression."""
    return "`" + name.replace("`", "``") + "`"


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Aside:
    """The columns of ``docs`` set aside as ``_0``, ``_1`` and so on, so that no
    name of theirs meets one of a plan's own.

    Columns named like a result (in any case) are left out.
    """

    def __init__(self, docs: DataFrame, *results: str):
        lowered = {r.lower() for r in results}
        kept = [c for c in docs.columns if c.lower() not in lowered]
        self.docs = docs.select(*[F.col(quoted(c)).alias(f"_{k}") for k, c in enumerate(kept)])
        self.own = [f"_{k}" for k in range(len(kept))]
        self.back = [F.col(f"_{k}").alias(c) for k, c in enumerate(kept)]
        self._place = {c.lower(): f"_{k}" for k, c in enumerate(kept)}

    def __call__(self, name: str) -> str:
        """The name under which a column is set aside."""
        return self._place[name.lower()]
