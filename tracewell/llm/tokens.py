"""Token counts: lengths only, encoded in batches of bounded size.

Defined results: a null text has no bytes and no tokens; special strings in a
text count as the library's default has them; repeated rows count each; a very
long text is cut at safe spaces and counted in parts; other columns stay, but
those named like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.pieces import TokenCounter, by_size, shared
from tracewell.llm.workspace import Aside, read_documents

#: Bytes of text that are encoded together.
BATCH_BYTES = 4_000_000


def n_tokens(text: Column, tokenizer: str) -> Column:
    """The number of tokens of ``text`` (a byte-level tokenizers file)."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared(TokenCounter, tokenizer)
        for batch in batches:
            texts = (x.as_py() or "" for x in batch)
            sizes = pc.binary_length(batch).fill_null(0).to_pylist()
            yield pa.array([n for group in by_size(texts, BATCH_BYTES, sizes) for n in counter(group)], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    There is no shuffle: rows are counted where they are read, and the bytes
    encoded at once are bounded whatever the rows hold.
    """
    aside = Aside(docs, "n_bytes", "n_tokens", "over_limit")
    text = F.coalesce(F.col(aside(text_col)), F.lit(""))
    counted = aside.docs.withColumn("n_tokens", n_tokens(text, tokenizer))
    return counted.select(*aside.back, "n_tokens", F.octet_length(text).cast("long").alias("n_bytes"), (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
