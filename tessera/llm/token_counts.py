"""Token counts: the exact histogram of encoded lengths, and by its suffix sums the answers for every context limit.

Documents are encoded once, tasks pre-aggregate by length, and all answers come from the histogram, whose size is the number of
distinct lengths. Sums run in two levels (blocks of lengths, then the lengths of a block), so no task holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _tokens
from tessera.llm._io import stash

BLOCK = 1024


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(_tokens.ids(path, t.as_py())) for t in b.column(0)]
            length, docs = np.unique(np.array(n, np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"length": pa.array(length, pa.int64()), "n_docs": pa.array(docs, pa.int64())})

    return run


def length_histogram(df: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(length, n_docs) for each encoded length; null and empty texts have length 0, repeated rows count each, an empty table gives no row."""
    path = tokenizer_path or _tokens.default_path()
    return df.select(text_col).mapInArrow(_counts(path), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram: n_docs, docs_at_most, docs_longer, total_tokens, tokens_in_longer, truncated_tokens (each document cut to L) and fraction_at_most."""
    block = F.floor(F.col("length") / BLOCK)
    rows = histogram.withColumns({"block": block, "tokens": F.col("length") * F.col("n_docs")})
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"))
    total = rows.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("total_tokens"))
    above = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("later_docs")
    beyond = F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("later_tokens")
    out = rows.join(blocks, "block").withColumns({"docs_longer": longer, "tokens_in_longer": beyond}).join(F.broadcast(total))  # one row
    return out.select("length", "n_docs", (F.col("all_docs") - F.col("docs_longer")).alias("docs_at_most"), "docs_longer", "total_tokens", "tokens_in_longer", (F.col("total_tokens") - F.col("tokens_in_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"), (1 - F.col("docs_longer") / F.col("all_docs")).alias("fraction_at_most"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit asked: context_limit, docs_whole, docs_cut, kept_tokens, cut_tokens, chunks (pieces of at most the limit)."""
    rows = histogram.select("length", "n_docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"))
    cut, n = F.col("length") > F.col("context_limit"), F.col("n_docs")
    kept = F.least("length", "context_limit") * n
    return rows.groupBy("context_limit").agg(F.sum(F.when(cut, 0).otherwise(n)).alias("docs_whole"), F.sum(F.when(cut, n).otherwise(0)).alias("docs_cut"), F.sum(kept).alias("kept_tokens"), F.sum(F.col("length") * n - kept).alias("cut_tokens"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("context_limit"))) * n).alias("chunks"))


def quantiles(histogram: DataFrame, fractions: list[float]) -> DataFrame:
    """For each fraction q: the least length that at least q of all documents do not exceed."""
    rows = suffix_sums(histogram).select("length", "fraction_at_most", F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("fraction"))
    return rows.where(F.col("fraction_at_most") >= F.col("fraction") - 1e-12).groupBy("fraction").agg(F.min("length").alias("length"))


def token_counts(df: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """suffix_sums() of df's texts; the histogram is stored in between, so the texts are encoded once."""
    return suffix_sums(stash(length_histogram(df, text_col, tokenizer_path), "lengths"))
