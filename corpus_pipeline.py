"""A training corpus from raw documents: language, exact copies, near copies, the mix, and packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives the next one's docs. All but the last keep the
columns of documents. run() applies them in turn, each stage's result written as a table in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, mixing, near_dedup, packing
from tessera.llm._io import stash
from tessera.llm.queries import MIX

#: A text is rejected if it has no letter, or if no language's mean posterior is this part of the way from chance to 1; clean texts are far above.
LANGUAGE_MARGIN = 1 / 15
#: What that is with the four languages of the data.
LEAST_LANGUAGE_SCORE = 0.3

#: Bytes of a batch of rows on its way to a Python worker. Rows carry whole texts here, and an executor holds several copies of each task's batches; Spark's default is 64 MB.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # read when the rows are made, so it stays
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: without texts that are in no language; the classifier learns from the labelled rows. Without a labelled row, all texts with a letter stay."""
    tagger = language_id.train(docs.select("text", "lang"), language_id.Settings())
    return language_id.accept(docs, tagger, LANGUAGE_MARGIN)


@_in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts the row with the least doc_id stays."""
    return exact_dedup.drop_copies(docs)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-deduplication: one document of each group stays, five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_copies(docs)


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: all rows, laid out along the mix."""
    return mixing.mixed_layout(docs, settings=MIX)


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing along the mix: pieces of at most 2048 tokens and their places; neighbours in the mix share sequences, which are numbered along it. Files do not keep the order of rows, so each row's place in the mix is found anew."""
    return packing.pack_mixed(docs, MIX)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, signatures, schedule and packing have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name)
    return docs
