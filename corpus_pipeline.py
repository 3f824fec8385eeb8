"""From raw documents to packed training sequences.

Each stage is written as Parquet and read again as the next one's documents, so
a lost executor never costs an earlier stage; a stage's table goes once the next
one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import line_dedup, mixing, packing, quality, simhash
from tracewell.llm.workspace import Workspace

#: Name and function of (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", line_dedup.stage),
    ("near-duplicates", simhash.stage),
    ("source mixing", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Tokens and fingerprints can't be computed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"stage-{k}")
            work.drop(f"stage-{k - 1}")
    return docs
