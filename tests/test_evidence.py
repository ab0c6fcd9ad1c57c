from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import ops as O
from tessera.operators import structure as S


def test_activation(spark):
    docs = spark.createDataFrame([("d", "g1", 1, "ready"), ("e", "h1", 1, "ready")], "document string, active string, version int, layout_status string")
    gens = spark.createDataFrame([("g1", "d", 1, "active", 1.0), ("g2", "d", 2, "building", 0.5), ("g0", "d", 0, "failed", 0.0), ("h1", "e", 1, "active", 1.0)], "generation string, document string, version int, state string, completeness double")
    chunks = spark.createDataFrame([("c1", "d", "g1", [1.0]), ("c2", "d", "g2", [1.0]), ("c3", "d", None, [1.0]), ("c4", "e", "h1", [1.0])], "chunk string, document string, generation string, embedding array<double>")
    out = E.activate_generations({"documents": docs, "generations": gens, "chunks": chunks}, gens.where("generation = 'g2'").select("generation"))
    assert {tuple(r) for r in out["documents"].collect()} == {("d", "g2", 2, "partial"), ("e", "h1", 1, "ready")}
    assert {r["generation"]: r["state"] for r in out["generations"].collect()} == {"g1": "retired", "g2": "partial", "g0": "failed", "h1": "active"}
    assert {r["chunk"]: r["embedding"] is None for r in out["chunks"].collect()} == {"c1": True, "c2": False, "c3": True, "c4": False}


def test_evidence_and_shown_pages(spark):
    asked = spark.createDataFrame([(c,) for c in "abcdef"], "chunk string")
    chunks = spark.createDataFrame([("a", "open", "r1"), ("b", "open", None), ("c", "shut", "r2")], "chunk string, document string, region string")
    docs = spark.createDataFrame([("open", "ready"), ("shut", "sealed")], "document string, status string")
    got = {r["chunk"]: r["status"] for r in E.evidence(asked, chunks, docs, asked.where("chunk = 'd'")).collect()}
    assert got == {"a": "ok", "b": "legacy", "c": "sealed", "d": "sealed", "e": "not_found", "f": "not_found"}
    asked = spark.createDataFrame([("a", "d", 1, None), ("b", "d", 1, 2), ("c", "d", 1, 9)], "chunk string, document string, own_page int, wanted_page int")
    surfaces = spark.createDataFrame([("d", 1), ("d", 2)], "document string, page int")
    assert {r["chunk"]: (r["page"], r["shows_region"]) for r in E.shown_surface(asked, surfaces).collect()} == {"a": (1, True), "b": (2, False), "c": (1, True)}


def test_sealing_needs_a_ready_document(spark):
    docs = spark.createDataFrame([("d", "ready"), ("e", "processing")], "document string, status string")
    chunks = spark.createDataFrame([("c1", "d"), ("c2", "e")], "chunk string, document string")
    cipher = spark.createDataFrame([("d", 0, "x", "s", "n"), ("e", 0, "x", "s", "n")], "document string, ordinal int, ciphertext string, salt string, nonce string")
    out = E.seal({"documents": docs, "chunks": chunks, "generations": docs.select("document"), "sealed_chunks": cipher.where("false"), "tombstones": chunks.where("false")}, cipher)
    assert {tuple(r) for r in out["documents"].collect()} == {("d", "sealed"), ("e", "processing")}
    assert [r["chunk"] for r in out["chunks"].collect()] == ["c2"] and [r["chunk"] for r in out["tombstones"].collect()] == ["c1"] and [r["document"] for r in out["sealed_chunks"].collect()] == ["d"]


def test_picture_budget(spark):
    rows = [(1, i, f"r{i % 6}", "chart" if i != 2 else "list", 1_000_000) for i in range(8)] + [(2, 0, "a", "table", 7_000_000), (2, 1, "b", "table", 10)]
    df = spark.createDataFrame(rows, "qid int, position int, region string, region_type string, n_bytes long")
    assert sorted((r["qid"], r["position"]) for r in E.visual_budget(df).collect()) == [(1, 0), (1, 1), (1, 3), (1, 4)]


def test_vision_results_are_all_or_nothing(spark):
    regions = spark.createDataFrame([(p, i, "paragraph", t) for p in (1, 2, 3) for i, t in enumerate(["kept", ""])], "page_id int, ordinal int, region_type string, content string")
    item = '{"local_ordinal": %d, "type": "%s", "bbox": [10, 20, 5, 2000], "content": "new", "summary": ""}'
    good = '{"regions": [' + item % (0, "chart") + "," + item % (1, "image") + "]}"
    payloads = spark.createDataFrame([(1, good), (2, '{"regions": [' + item % (0, "chart") + "," + item % (7, "chart") + "]}"), (3, "{")], "page_id int, payload string")
    got = {(r["page_id"], r["ordinal"]): (r["region_type"], r["content"], r["bbox"], r["summary"], r["source"]) for r in S.merge_vision(regions, payloads).collect()}
    assert got[(1, 0)] == ("chart", "kept", [0.02, 0.005, 1.0, 0.01], None, "merged") and got[(1, 1)][1] == "new" and got[(1, 1)][4] == "vision"
    assert all(got[(p, i)] == ("paragraph", ["kept", ""][i], None, None, "local") for p in (2, 3) for i in (0, 1))


def test_embedding_goes_on_from_its_checkpoint(spark):
    chunks = spark.createDataFrame([("d", i, "down" if i == 3 else None) for i in range(5)] + [("e", 0, None)], "document string, ordinal int, error string")
    jobs = spark.createDataFrame([("d", "p", 0), ("e", "other", -1), ("f", "p", -1)], "document string, provider string, checkpoint int")
    got = {r["document"]: tuple(r)[1:] for r in O.embed_outcomes(chunks, jobs, ["p"]).collect()}
    assert got == {"d": (2, "failed", "down", 2), "e": (-1, "failed", "provider_not_configured", 0), "f": (-1, "ready", None, 0)}


def test_agent_cards_and_changes(spark):
    asked = spark.createDataFrame([(1, "b1", "doing", "x"), (2, "b1", "nope", "x"), (3, "b1", None, "x"), (4, "zz", "todo", "x")], "id int, board string, column string, title string")
    boards = spark.createDataFrame([("b1", ["todo", "doing"])], "board string, columns array<string>")
    assert {r["id"]: r["column"] for r in O.agent_cards(asked, boards).collect()} == {1: "doing", 2: "todo", 3: "todo"}
    log = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("k", 3, "a"), ("k", 4, "a"), ("k", 5, "b")], "key string, t int, v string")
    assert sorted(r["t"] for r in O.changes(log, "key", ["t"], ["v"]).collect()) == [1, 3, 5]


def test_reindexing_and_resuming(spark):
    cases = [("sealed", "ready", "document_sealed"), ("ready", "building", "already_queued"), ("processing", "ready", "already_queued"), ("ready", "legacy", "queued"), (None, None, "not_found")]
    df = spark.createDataFrame(cases, "status string, layout string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", E.reindex_decision(F.col("status"), F.col("layout")).alias("got")).collect())
    cases = [(True, "failed", "failed", "upload_expired", True, "resumed"), (True, "failed", "failed", "corrupt", True, "upload_not_resumable"), (True, "processing", "uploading", None, False, "upload_not_resumable"), (True, "processing", None, None, True, "upload_not_resumable"), (False, "processing", "uploading", None, True, "not_found"), (True, "ready", "uploading", None, True, "upload_not_resumable")]
    df = spark.createDataFrame(cases, "owned boolean, status string, state string, error string, path boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", E.resume_decision(F.col("owned"), F.col("status"), F.col("state"), F.col("error"), F.col("path")).alias("got")).collect())
