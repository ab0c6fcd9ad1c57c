"""The approximate vector index: recall against exact search, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann
from tessera.operators import retrieval as R
from tessera.sources.scratch import new_path


def _recall(spark, corpus, queries, k=20, **settings):
    path = new_path(spark, "vectors")
    index = ann.build_index(corpus, path, ann.Settings(**settings))
    again = ann.open_index(spark, path, index.settings)
    found = {(r["qid"], r["id"], r["distance"]) for r in again.search(corpus, queries, k).collect()}
    want = {(r["qid"], r["id"], r["distance"]) for r in R.nearest(corpus, queries, k).collect()}
    assert len(found) == len(want)
    return len(found & want) / len(want), index


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    recall, index = _recall(spark, rows, asked)
    assert recall >= 0.95 and index.codes.count() == rows.count()


def test_few_cells_are_met_where_vectors_gather(spark, monkeypatch):
    """Small chunks and blocks of questions, a place with a third of all vectors, and one vector in many copies."""
    monkeypatch.setattr(ann, "CHUNK_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    place = rng.normal(size=(40, 24))
    at = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 40, 3000))
    x = place[at] + 0.05 * rng.normal(size=(3000, 24))
    x[2000:2300] = x[2000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    recall, index = _recall(spark, rows, rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), k=10, short=400)
    assert recall >= 0.95 and index.model.probes <= len(index.model.centres) // 2


def test_nulls_zeros_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [-1.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = corpus.select(F.col("id").alias("qid"), "embedding")
    assert _recall(spark, corpus, asked, k=2)[0] == 1.0
    none = ann.build_index(corpus.limit(0), new_path(spark, "vectors"))
    assert none.search(corpus, asked, 3).count() == 0
    assert ann.build_index(corpus, new_path(spark, "vectors")).search(corpus, asked.limit(0), 3).count() == 0


def test_a_question_is_sent_once_a_chunk_and_not_once_a_cell(spark, monkeypatch):
    found, plain = [], ann.stash
    monkeypatch.setattr(ann, "stash", lambda df, name: found.append((name, plain(df, name))) or found[-1][1])
    x = np.random.default_rng(6).normal(size=(2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = ann.build_index(rows, new_path(spark, "vectors"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    assert index.model.probes > len(index.model.centres) // 2  # these vectors do not gather
    assert index.search(rows, asked, 10).count() == 1000
    assert {name: df.count() for name, df in found} == {"questions": 100, "short": 100 * index.settings.short}  # a row a question and cell before
