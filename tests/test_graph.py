import numpy as np
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import graph as G
from tessera.operators import retrieval as R


def _vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<double>")


def test_two_blobs_are_told_apart(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([[[0.0] * 5], [[10.0] * 5], rng.normal(0, 0.05, (19, 5)), rng.normal(10, 0.05, (19, 5))])
    rows = {r["id"]: r["cluster"] for r in G.kmeans(_vectors(spark, points), 2).collect()}
    assert all(rows[i] == (0 if points[i].mean() < 5 else 1) for i in rows)


def test_more_clusters_than_points_and_none_at_all(spark):
    assert len({r["cluster"] for r in G.kmeans(_vectors(spark, np.eye(3)), 10).collect()}) == 3
    assert G.kmeans(_vectors(spark, np.eye(3)).where("id < 0"), 3).count() == 0
    v = _vectors(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None)], "id long, embedding array<double>"))
    assert 9 not in {r["id"] for r in G.kmeans(v, 2).collect()}


def test_seeds_are_the_same_at_any_partitioning_and_better_than_the_least_ids(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(rng.integers(0, 8, 400)[:, None] * 10, 0.5, (400, 3))
    points[:8] = 0  # the least ids are all alike
    v = _vectors(spark, points)
    for rounds in (0, 3):
        one, other = G.seeds(v.coalesce(1), 8, rounds), G.seeds(v.repartition(7), 8, rounds)
        assert np.array_equal(one, other) and len(np.unique(one, axis=0)) == 8
        inertia = lambda rows: sum(r["distance"] ** 2 for r in rows.collect())
        assert inertia(G.kmeans(v, 8, 5, one)) < 0.5 * inertia(G.kmeans(v, 8, 5))
    assert not np.array_equal(G.seeds(v, 8), G.seeds(v, 8, seed=1))


def test_seeds_of_few_rows_copies_and_none(spark):
    v = _vectors(spark, np.ones((5, 2)))
    assert G.seeds(v, 3).tolist() == [[1.0, 1.0]] * 3 and len(G.seeds(v, 9)) == 5 and len(G.seeds(v, 2, 3)) == 2
    assert len(G.seeds(v.where("false"), 3)) == 0 and len(G.seeds(v.where("false"), 3, 2)) == 0
    assert G.kmeans(v.where("false"), 3, start=G.seeds(v.where("false"), 3)).count() == 0
    chosen = G.seeds(_vectors(spark, [[0.0], [0.0], [0.0], [7.0]]), 2)
    assert sorted(chosen.ravel().tolist()) == [0.0, 7.0]  # what lies at a centre is never drawn before what does not


def test_ancestors_of_a_deep_chain_a_tree_and_rings(spark):
    chain = [(i, i - 1 if i else None) for i in range(51)]
    more = [(100, 50), (101, 999), (200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (None, 3), (10, 9), (10, 77)]
    got = {r["node"]: (r["path"], r["looped"]) for r in G.ancestors(spark.createDataFrame(chain + more, "node long, parent long")).collect()}
    assert len(got) == 51 + 7 and all(got[i] == (list(range(i)), False) for i in range(51))
    assert got[100] == (list(range(51)), False) and got[101] == ([], False)  # a parent that is no node
    assert got[200] == ([202, 201], True) and got[203] == ([202, 201, 200], True) and got[300] == ([], True)
    assert G.ancestors(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_choose_k(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 30, 300)], "n long").select("n", scalars.choose_k(F.col("n")).alias("k")).collect()
    k = [r["k"] for r in sorted(rows)]
    assert k[:2] == [1, 1] and k == sorted(k) and k[-1] == round((300 / 2) ** 0.5)


def test_neighbours(spark):
    v = _vectors(spark, [[0.0], [0.1], [50.0]])
    near = {r["qid"]: r["id"] for r in R.nearest(v, v.withColumnRenamed("id", "qid"), 1, "l2", skip_self=True).collect()}
    assert near[0] == 1 and near[1] == 0 and near[2] == 1
    one = v.where("id = 0")
    assert R.nearest(one, one.withColumnRenamed("id", "qid"), 3, "l2", skip_self=True).count() == 0


def test_placing_without_clusters(spark):
    v = _vectors(spark, [[0.0], [5.0]])
    assert [r["cluster"] for r in G.place(v, v.where("false").withColumnRenamed("id", "cluster")).collect()] == [None, None]
    centres = spark.createDataFrame([(7, [4.0]), (3, [0.5])], "cluster int, embedding array<double>")
    assert {r["id"]: r["cluster"] for r in G.place(v, centres).collect()} == {0: 3, 1: 7}


def _edge(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, weight double, explicit boolean, last timestamp")


def test_decay(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 1, 10)
    rows = [("a", "b", 10.0, False, now), ("a", "c", 10.0, False, now - timedelta(hours=168)), ("a", "d", 10.0, False, now + timedelta(hours=24)), ("a", "e", 5.0, True, datetime(2020, 1, 1))]
    got = {r["b"]: r["effective"] for r in G.effective(_edge(spark, rows), F.lit(now)).collect()}
    assert got == {"b": 10.0, "c": 5.0, "d": 10.0, "e": 5.0}


def test_document_links(spark):
    from datetime import datetime

    now = datetime(2026, 1, 10)
    rows = [("a1", "a2", 9.0, False, now), ("a1", "b1", 2.0, False, now), ("b2", "a2", 3.0, True, now), ("a1", "zz", 9.0, False, now), ("a1", "c1", 1.0, False, now)]
    owner = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("c1", "C")], "chunk string, document string")
    got = G.document_links(G.effective(_edge(spark, rows), F.lit(now)), owner).collect()
    assert [(r["document_a"], r["document_b"], r["weight"], r["explicit"]) for r in got] == [("A", "B", 5.0, True)]


def test_co_retrieval_and_explicit_links(spark):
    turns = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "c")], "turn int, chunk string").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    edges = G.co_retrieval(turns)
    assert {(r["a"], r["b"]): r["turns"] for r in edges.collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    links = spark.createDataFrame([("b", "a"), ("d", "a"), ("x", "x")], "a string, b string")
    got = {(r["a"], r["b"]): (r["weight"], r["turns"], r["explicit"]) for r in G.link_explicitly(edges, links).collect()}
    assert got[("a", "b")] == (5.0, 0, True) and got[("a", "d")] == (5.0, 0, True) and got[("a", "c")] == (1.0, 1, False) and len(got) == 4


def test_components_in_three_dimensions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6)) * [9, 5, 3, 0.1, 0.1, 0.1]
    got = np.array([[r["x"], r["y"], r["z"]] for r in G.project_3d(_vectors(spark, x)).orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_pairs_are_dealt_over_tasks_by_their_number_and_edges_made_once(spark, monkeypatch):
    rows = [(t, (t * 7 + i * (t % 3 + 1)) % 50, i) for t in range(90) for i in range(12)] + [(200, 1, 0), (201, None, 0), (201, 4, 0), (201, 5, 0)]
    retrieved = spark.createDataFrame(rows, "turn int, chunk int, i int").withColumn("ts", F.timestamp_seconds(F.col("turn") * 100 + F.col("i")))
    found = {}
    for t, c, i in rows:
        found.setdefault(t, {}).setdefault(c, []).append(t * 100 + i)
    want = {}
    for t, chunks in found.items():
        last = max(max(v) for v in chunks.values())
        for a in chunks:
            for b in chunks:
                if a is not None and b is not None and a < b:
                    n, at = want.get((a, b), (0, 0))
                    want[(a, b)] = (n + 1, max(at, last))
    for most in (G.TASK_ROWS, 10):
        monkeypatch.setattr(G, "TASK_ROWS", most)
        edges = G.co_retrieval(retrieved)
        assert {(r["a"], r["b"]): (r["turns"], r["last"]) for r in edges.select("a", "b", "turns", F.unix_seconds("last").alias("last")).collect()} == want
    pairs = sum(len(v) * (len(v) - 1) // 2 for v in found.values())
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert pairs // 10 > 500 and plan.count(f", {-(-pairs // 10)}), REPARTITION_BY_NUM") == 2, plan
    near = G.touching(edges.select("a", "b", "turns"), spark.createDataFrame([(3,), (3,), (49,), (None,)], "chunk int"))
    got = [(r["a"], r["b"], r["turns"]) for r in near.collect()]
    assert sorted(got) == sorted((a, b, n) for (a, b), (n, _) in want.items() if {a, b} & {3, 49})
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [a") == 1


def test_sums_and_joins_of_edges_are_dealt_by_their_number(spark, monkeypatch):
    from tessera.functions import joins

    rows = [(t, (t * 7 + i * (t % 3 + 1)) % 50) for t in range(90) for i in range(12)]
    retrieved = spark.createDataFrame(rows, "turn int, chunk int").withColumn("ts", F.timestamp_seconds("turn"))
    links = spark.createDataFrame([(3, 1), (1, 3), (7, 7), (60, 61)], "a int, b int")
    owner = spark.createDataFrame([(c, f"d{c % 4}") for c in range(62)], "chunk int, document string")
    found = {}
    for rows_a_task, sent in ((G.TASK_ROWS, joins.BROADCAST_ROWS), (40, 5)):
        monkeypatch.setattr(G, "TASK_ROWS", rows_a_task)
        monkeypatch.setattr(joins, "BROADCAST_ROWS", sent)
        edges = G.link_explicitly(G.co_retrieval(retrieved), links).withColumn("effective", F.col("weight"))
        docs = G.document_links(edges, owner)
        found[sent] = sorted(edges.select("*").collect()), sorted(docs.select("*").collect())
    assert len({len(x) for pair in found.values() for x in pair}) == 2 and len(set(map(str, found.values()))) == 1
    turns = {}
    for t, c in rows:
        turns.setdefault(t, set()).add(c)
    tasks = -(-sum(len(x) * (len(x) - 1) // 2 for x in turns.values()) // 40)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert tasks > 100 and plan.count(f", {2 * tasks}), REPARTITION_BY_NUM") == 1, plan
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [a") == 2  # of edges and of links, each made once
    plan = docs._jdf.queryExecution().executedPlan().toString()
    n = -(-len(found[5][0]) // 40)
    assert n > 10 and plan.count(f", {n}), REPARTITION_BY_NUM") == 4, plan
