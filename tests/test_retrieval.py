import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators import search as S


def _leg(spark, ids, qid=1):
    return spark.createDataFrame([(qid, x, i + 1) for i, x in enumerate(ids)], "qid long, id string, rank int")


@pytest.mark.parametrize(("legs", "want"), [(["ABC", "BCA"], "BAC"), (["XY", "XZ"], "XYZ"), (["", ""], ""), (["ABC", ""], "ABC"), (["A", "B"], "AB")])
def test_fusion(spark, legs, want):
    rows = R.rrf([_leg(spark, list(x)) for x in legs]).orderBy("position").collect()
    assert "".join(r["id"] for r in rows) == want


@pytest.mark.parametrize(("documents", "want"), [("aaaabc", [0, 1, 2, 4, 5]), ("aaaaaa", [0, 1, 2, 3, 4]), ("aaaab", [0, 1, 2, 4, 3]), ("", [])])
def test_diversity(spark, documents, want):
    df = spark.createDataFrame([(1, i, x, i + 1) for i, x in enumerate(documents)], "qid long, id long, doc string, position int")
    assert [r["id"] for r in R.diversify(df, "doc").orderBy("final").collect()] == want


def test_diversity_against_a_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for q in range(60):
        docs = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        rows += [(q, i, x, i + 1) for i, x in enumerate(docs)]
        taken, passed = [], []
        for i, x in enumerate(docs):
            (taken if sum(docs[j] == x for j in taken) < 3 and len(taken) < 5 else passed).append(i)
        want[q] = (taken + passed)[:5]
    df = spark.createDataFrame(rows, "qid long, id long, doc string, position int")
    got = {}
    for r in R.diversify(df, "doc").orderBy("qid", "final").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want


def test_pages_regions_and_evidence(spark):
    leg = spark.createDataFrame([(1, "a", 1, 4), (1, "b", 2, 12)], "qid long, id string, rank int, page int")
    asked = lambda q: T.explicit_page(F.lit(q))
    order = lambda q: [r["id"] for r in R.page_boost(leg, F.col("page"), asked(q)).orderBy("rank").collect()]
    assert order("What does the chart on page 12 imply?") == ["b", "a"] and order("compare 12 charts") == ["a", "b"]
    fused = spark.createDataFrame([(1, x, r, i) for i, (x, r) in enumerate([("visual", "s"), ("caption", "s"), ("legacy-a", None), ("legacy-b", None)])], "qid long, id string, region string, position int")
    assert [r["id"] for r in R.dedupe_regions(fused, F.col("region")).orderBy("position").collect()] == ["visual", "legacy-a", "legacy-b"]
    [row] = spark.range(1).select(T.serialize_evidence(F.lit("Report"), F.lit("A > B"), F.lit(7), F.lit("chart"), F.lit("body")).alias("x"), T.serialize_evidence(F.lit(""), *[F.lit(None).cast("string")] * 4).alias("y")).collect()
    assert row["x"].split("\n") == ["Document: Report", "Heading: A > B", "Page: 7", "Region: chart", "Content: body"]
    assert row["y"].split("\n") == ["Document: Untitled", "Heading: Root", "Page: n/a", "Region: text", "Content: "]


def test_the_floor_is_inclusive(spark):
    rows = spark.createDataFrame([(1, "alpha", 1), (2, "beta", 1), (3, "gamma", 2)], "id long, text string, scope int")
    asked = spark.createDataFrame([(7, 1, "alpha x y z w alpha"), (8, 2, "alpha gamma"), (9, 2, "alpha"), (10, 1, ""), (11, 5, "alpha")], "qid int, scope int, text string")
    got = {(r["qid"], r["id"], r["relevance"], r["rank"]) for r in R.scoped(rows, asked).collect()}
    assert got == {(7, 1, 0.2, 1), (8, 3, 0.5, 1)}


def test_candidates_are_described_put_in_context_and_captioned_before_they_are_judged(spark):
    chunks = spark.createDataFrame(
        [(1, "d1", 1, 10, "chart", ""), (2, "d1", 2, 10, "chart", "late"), (3, "d1", 3, None, None, "growth text"), (4, "d2", 4, None, None, None), (5, "d3", 5, 50, "paragraph", "own"), (6, "d4", 6, 60, "image", " ")],
        "id long, document string, page int, region long, region_type string, content string",
    )
    legs = [spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(x)], "qid long, id long, rank int") for x in ([1, 2, 3, 5], [6, 4])]
    asked = spark.createDataFrame([(1, 3)], "qid long, page int")
    seen = []

    def describe(regions):
        seen.extend(sorted(r["region"] for r in regions.collect()))
        return regions.where("region = 10").selectExpr("region", "'growth curve' AS caption")

    context = spark.createDataFrame([(50, 1, "growth after"), (50, 0, "before"), (50, 2, "own")], "region long, position int, content string")
    captions = spark.createDataFrame([("d2", "a photo of growth"), ("d4", "nothing here")], "document string, caption string")
    questions = spark.createDataFrame([(1, "growth")], "qid long, text string")
    known = R.Evidence(chunks, asked, describe, context, captions)
    got = {r["id"]: (r["content"], r["relevance"], r["final"]) for r in R.retrieve(legs, known, R.overlap_with_evidence(questions)).collect()}
    assert seen == [10, 60]  # one row a region, and only visual regions without content
    assert {i: c for i, (c, _, _) in got.items()} == {3: "growth text", 1: "growth curve", 4: "a photo of growth", 5: "own\n\nbefore\n\ngrowth after"}
    assert min(got, key=lambda i: got[i][2]) == 3  # the page that was asked for
    down = R.retrieve(legs, R.Evidence(chunks), None).collect()
    assert {r["id"] for r in down} == {1, 3, 4, 5, 6} and all(r["relevance"] == 1 for r in down)
    sealed = spark.createDataFrame([(1, 99, "d9", "plain")], "qid long, id long, document string, content string")
    assert [(r["id"], r["final"], r["content"]) for r in R.retrieve([None, None], known, None, sealed=sealed).collect()] == [(99, 6, "plain")]
    assert R.retrieve([None], known, None).columns == ["qid", "id", "document", "relevance", "final", "content"]


def test_nearest_against_all_pairs(spark, sf):
    import numpy as np

    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = v.orderBy("id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["id"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 9)
    got = {}
    for r in R.nearest(v.repartition(7), v.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for q, found in got.items():
        i = int(np.flatnonzero(ids == q)[0])
        assert found == ids[np.lexsort((ids, d[i]))[:5]].tolist()
    assert len(got) == sum(i % 50 == 0 for i in ids)


def test_web_queries(spark):
    [a, b] = S.web_query('red -"big dog" blue OR state-of -x')
    assert a.wanted == [("red",), ("blue",)] and a.unwanted == [("big", "dog")] and b.wanted == [("state", "of")] and b.unwanted == [("x",)]
    docs = spark.createDataFrame([(1, "Red and blue"), (2, "red blue big dog"), (3, "State of mind"), (4, "state x of"), (5, None)], "id long, text string")
    assert {r["id"] for r in S.web_search(docs, 'red -"big dog" blue OR state-of -x').collect()} == {1, 3}
    assert S.web_search(docs, "  ").count() == 0 and S.web_search(docs, "or").count() == 0


def test_overview_of_a_document(spark):
    rows = spark.createDataFrame([("a", i) for i in range(12)] + [("b", i) for i in range(3)], "doc string, at int")
    got = R.evenly_spaced(rows, "doc", "at").groupBy("doc").agg(F.array_sort(F.collect_list("at")).alias("x")).collect()
    assert {r["doc"]: r["x"] for r in got} == {"a": [round(i * 11 / 4) for i in range(5)], "b": [0, 1, 2]}


def test_plans(spark, sf):
    from tessera.plans.catalogue import QUERIES

    plan = lambda n: QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan("tenant_documents") and "EqualTo(source,src3)" in plan("tenant_documents") and "text" not in plan("tenant_documents").split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan("vector_topk")
    assert "WindowGroupLimit" in plan("knn_edges")
    for n in ("associative_doc_edges", "edges_touching", "related_regions", "hybrid_search", "region_context"):
        assert "Cartesian" not in plan(n) and "NestedLoop" not in plan(n)


def test_all_words_of_a_question_are_searched(spark):
    questions = spark.createDataFrame([(1, "The elephants remember mountains, rivers and a sea"), (2, "sea"), (3, "!")], "qid long, text string")
    docs = spark.createDataFrame([(1, "elephants remember mountains rivers"), (2, "A sea; and the rivers: mountains remember ELEPHANTS the"), (3, "sea sea"), (4, None)], "id long, text string")
    assert {(r["qid"], r["id"], r["rank"]) for r in S.best_matches(docs, questions).collect()} == {(1, 2, 1), (2, 3, 1), (2, 2, 2)}
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 1)], "qid long, id long")
    assert {(r["qid"], r["id"]): r["relevance"] for r in R.overlap(docs, questions)(pairs).collect()} == {(1, 1): 4 / 8, (1, 2): 1.0, (1, 3): 1 / 8, (2, 2): 1.0, (2, 3): 1.0, (3, 1): 0.0}


def test_questions_in_the_web_style_at_once(spark):
    """Alternatives, phrases and exclusions of many questions, and letters beyond ASCII; each as the search of one query has it. Questions that differ in their fifth-longest word alone differ."""
    asked = ["alpha beta", 'alpha or "beta gamma"', "beta -gamma", '"größe straße"', "größe", "nothing here", "-alpha", "alpha alpha beta", "wonderful elephants remember mountains sea", "wonderful elephants remember mountains lake"]
    texts = ["alpha beta gamma", "beta, gamma!", "gamma beta alpha", "Größe: Straße", "straße größe", "beta", None, "wonderful elephants remember the mountains and a lake", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["qid"], r["id"]): r["score"] for r in S.matching(docs, spark.createDataFrame(list(enumerate(asked)), "qid long, text string")).collect()}
    want = {(k, r["id"]): r["score"] for k, q in enumerate(asked) if q != "-alpha" for r in S.web_search(docs, q, None).collect()}
    assert got == want and (9, 7) in got and (8, 7) not in got


def test_many_questions_make_a_grid(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    asked = v.where("id % 5 = 0").selectExpr("id AS qid", "embedding")
    for metric, skip in (("cosine", False), ("l2", True)):
        one = sorted(map(tuple, R.nearest(v, asked, 4, metric, skip).collect()))
        with monkeypatch.context() as m:
            m.setattr(R, "QUERY_BLOCK", 10)
            m.setattr(R, "CORPUS_BLOCK", 60)
            many = sorted(map(tuple, R.nearest(v, asked, 4, metric, skip).collect()))
        assert [x[:2] + x[3:] for x in many] == [x[:2] + x[3:] for x in one] and all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(one, many, strict=True))


def test_every_loader_keeps_to_its_tenant_and_to_what_may_be_seen(spark, sf):
    from tessera.sources.vault import Vault

    own, every = Vault(spark, sf, "src3"), Vault(spark, sf)
    ids = {r["id"] for r in own.documents().collect()}
    ready = {r["id"] for r in every.documents().where("status = 'ready'").collect()}
    assert ids and {r["id"] for r in own.searchable().collect()} == ids & ready
    assert {r["id"] for r in every.vectors().collect()} <= ready and {r["id"] for r in own.vectors().collect()} == ids & {r["id"] for r in every.vectors().collect()}
    assert {r["id"] for r in own.all_vectors().collect()} <= ids and every.all_vectors().count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert {r["session"] % 20 for r in own.messages().collect()} <= {3} and every.messages().count() == spark.read.parquet(f"{sf}/conversations.parquet").count()
