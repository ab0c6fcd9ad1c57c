from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions import text as T
from tessera.operators import chat as C
from tessera.operators import ops as O
from tessera.sources import sinks


def test_citations(spark):
    cases = {"[[chunk:id1]][[chunk:id2]]": ["id1", "id2"], "[[chunk:id1], [chunk:id2]]": ["id1", "id2"], "x [[chunk:id2]] [[chunk:nope]] [[chunk:id2]] [[chunk:id1]]": ["id2", "id1"], "none": []}
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(cases)], "session int, turn int, content string")
    got = {i: [] for i in range(len(cases))}
    for r in C.citations(df, F.array(F.lit("id1"), F.lit("id2"))).orderBy("session", "place").collect():
        got[r["session"]].append(r["chunk"])
    assert list(got.values()) == list(cases.values())


def test_token_estimates(spark):
    rows = spark.createDataFrame([("",), ("x" * 10,), ("x" * 14,)], "t string").select(scalars.estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 2, 4]


def test_the_question_is_strictly_earlier(spark):
    rows = [("s", 1, "assistant", "hello"), ("s", 2, "user", "q1"), ("s", 3, "assistant", "a1"), ("s", 4, "assistant", "a2")]
    got = C.with_question(spark.createDataFrame(rows, "session string, turn int, role string, content string")).orderBy("turn").collect()
    assert [r["question"] for r in got] == ["", "q1", "q1"]


def test_replay_falls_back_to_sealed(spark):
    cited = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 1, "c"), ("s", 2, "c")], "session string, turn int, chunk string")
    own = lambda rows: spark.createDataFrame(rows, "chunk string, document string")
    got = C.replay(cited, own([("a", "D1")]), own([("a", "D9"), ("b", "D2")])).collect()
    assert [(r["turn"], r["documents"]) for r in got] == [(1, ["D1", "D2"])]


def test_vague_questions(spark):
    cases = [("Hello!", True, True), ("what is this about?", False, True), ("what is this about?", True, False), ("what is the revenue", False, False), ("", False, False), ("summarize", False, True), ("Can you describe my documents?", False, True), ("hey", True, True), ("thanks", True, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, context boolean, want boolean")
    assert all(r["want"] == r["got"] for r in rows.select("*", T.needs_clarification(F.col("q"), F.col("context")).alias("got")).collect())


def test_prompt_without_context(spark):
    none = spark.createDataFrame([(1, 0, None, None, None)], "qid int, position int, chunk string, document string, content string")
    titles = spark.createDataFrame([], "document string, title string")
    assert C.instructions(none, titles, "H").first()["prompt"] == "H\n\nNo relevant context was found for this question."


def test_sliding_log():
    def allowed(times, limit=20, window=60.0):
        hits = deque()
        return [O.admit(hits, t, limit, window)[0] for t in times]

    assert allowed([float(i) for i in range(20)] + [59.9]) == [True] * 20 + [False]
    assert allowed([0.0] * 20 + [60.0])[-1]
    # denied requests are not recorded
    assert allowed([float(i) for i in range(20)] + [20 + i * 0.39 for i in range(100)] + [60.0])[-1]
    hits = deque([10.0])
    assert O.admit(hits, 15.0, 1, 60.0) == (False, 55.0)


def test_limits_are_apart_by_key_and_stream_in_order(spark):
    start = datetime(2026, 1, 1)
    rows = [("u1", i, start + timedelta(seconds=i)) for i in range(6)] + [("u2", 10 + i, start + timedelta(seconds=i)) for i in range(3)]
    df = spark.createDataFrame(rows, "user string, id long, ts timestamp")
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in O.rate_limited(df, 4, 60.0, ["user"]).collect()}
    assert [got[i][0] for i in range(6)] == [True] * 4 + [False] * 2 and got[4][1] == 56.0 and all(got[10 + i][0] for i in range(3))


def test_routes(spark):
    v = "/api/v1"
    cases = [("/health", "GET", None), ("/", "GET", None), (f"{v}/chat/sessions", "GET", "chat"), (f"{v}/documents/upload-init", "POST", "upload"), (f"{v}/documents/upload-init", "GET", "general"), (f"{v}/documents/1/unlock", "POST", "seal_unseal"), (f"{v}/documents/1/unseal/x", "POST", "general"), (f"{v}/graph/nodes", "GET", "graph"), (f"{v}/todos", "GET", "general")]
    df = spark.createDataFrame(cases, "path string, method string, want string")
    assert all(r["want"] == r["got"] for r in df.select("*", T.route_class(F.col("path"), F.col("method")).alias("got")).collect())


def test_evaluation_of_nothing_and_missing_flags(spark):
    schema = "expected_page int, expected_region_type string, correct_page boolean, retrieved_in_top_5 boolean, citations_resolved boolean, answer_correct boolean"
    assert list(O.evaluation(spark.createDataFrame([], schema)).first()) == [0.0] * 4
    rows = [(1, "chart", True, None, True, None), (None, "paragraph", None, True, False, True)]
    assert list(O.evaluation(spark.createDataFrame(rows, schema)).first()) == [1.0, 0.0, 0.5, 0.5]


def test_positions(spark):
    cases = [(1.0, 3.0, 2.0), (5.0, None, 1005.0), (None, 5.0, -995.0), (None, None, 0.0)]
    df = spark.createDataFrame(cases, "a double, b double, want double")
    assert all(r["want"] == r["got"] for r in df.select("*", scalars.position_between(F.col("a"), F.col("b")).alias("got")).collect())


def test_wrong_keys_and_bad_base64(spark):
    right, wrong = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    df = spark.createDataFrame([("secret",)], "t string").select(F.aes_encrypt("t", right, F.lit("GCM")).alias("raw"))
    rows = df.select(F.base64(F.substring("raw", 1, 12)).alias("nonce"), F.base64(F.expr("substring(raw, 13)")).alias("ciphertext"))
    assert O.decrypted(rows, right).first()["plain"] == "secret" and O.decrypted(rows, wrong).first()["plain"] is None
    assert O.decrypted(rows.withColumn("nonce", F.lit("%%%")), right).first()["plain"] is None


def test_deleting(spark):
    t = lambda rows: spark.createDataFrame(rows, "id int, document int")
    out = O.delete_documents({"chunks": t([(1, 1), (2, 2)]), "todos": t([(5, 1), (6, None), (7, 2)])}, spark.createDataFrame([(1,)], "document int"), ["chunks"], ["todos"])
    assert [(r["id"], r["document"]) for r in out["chunks"].collect()] == [(2, 2)]
    assert {r["id"]: r["document"] for r in out["todos"].collect()} == {5: None, 6: None, 7: 2}


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    once = sinks.upserted(base, changes, ["id"], "n")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, sinks.upserted(once, changes, ["id"], "n").collect())) == sorted(map(tuple, once.collect()))
    path = str(tmp_path / "graph")
    rows = lambda *x: spark.createDataFrame(list(x), "user_id string, node int")
    sinks.replace_tenants(rows(("u", 1), ("u", 2), ("v", 3)), path)
    sinks.replace_tenants(rows(("u", 9)), path)
    assert {(r["user_id"], r["node"]) for r in spark.read.parquet(path).collect()} == {("u", 9), ("v", 3)}
    log = str(tmp_path / "log")
    sinks.append_checked(base, log, {"has v": F.col("v").isNotNull()})
    with pytest.raises(Exception, match="broken rule: short"):
        sinks.append_checked(base, log, {"short": F.length("v") < 1})
    assert spark.read.parquet(log).count() == 2


def test_streams_agree_with_batches(spark, sf):
    from tessera.plans.catalogue import QUERIES

    batch = {(r["id"]): r["allowed"] for r in QUERIES["rate_limit_log"](spark, sf).collect()}
    assert {r["id"]: r["allowed"] for r in QUERIES["stream_rate_limit"](spark, sf).collect()} == batch
    edges = {(r["a"], r["b"]): r["turns"] for r in QUERIES["co_retrieval_edges"](spark, sf).collect()}
    assert {(r["a"], r["b"]): r["turns"] for r in QUERIES["stream_reinforce"](spark, sf).collect()} == edges


def test_tenants_and_files(spark, sf, tmp_path):
    from tessera.sources.vault import Vault, files

    assert {r["user_id"] for r in Vault(spark, sf, "src3").documents().collect()} == {"src3"} and Vault(spark, sf, "nobody").documents().count() == 0
    assert not {r["status"] for r in Vault(spark, sf).searchable().collect()} & {"sealed", "processing"}
    (tmp_path / "a.md").write_bytes(b"ok \xff bad")
    assert files(spark, str(tmp_path)).first()["source"] == "ok � bad"
