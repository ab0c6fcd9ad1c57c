"""Ownership, toggles, wipes, composed clustering, projections, the chunker, and what a request may leave out."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import layout as L
from tessera.operators import library as B
from tessera.plans.catalogue import QUERIES


def _plain_chunks(text, size, overlap):
    """The chunker's rule, place by place."""
    text, out, begin = text.strip(), [], 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            low = max(begin + 1, end - max(1, int(size * 0.2)))
            for width, ends in ((2, lambda x: x == "\n\n"), (2, lambda x: x[0] in ".!?" and x[1] in " \n"), (1, lambda x: x == "\n"), (1, str.isspace)):
                places = [i + width for i in range(low, end - width + 1) if ends(text[i : i + width])]
                if places:
                    end = places[-1]
                    break
        if text[begin:end].strip():
            out.append(text[begin:end].strip())
        if end == len(text):
            return out
        at = end - overlap
        while 0 < at < end and not (text[at - 1].isspace() and (text[at - 1 : at + 1].strip() or at == end - overlap)):
            at += 1
        begin = at if at > begin else end
    return out


def test_chunks_against_the_plain_rule():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["word", "a", " ", " ", "  ", ". ", "!\n", "\n", "\n\n", "z" * 12, "?", "é"]) for _ in range(rng.randint(0, 150)))
        size = rng.choice([10, 25, 60])
        overlap = rng.choice([0, 3, 8])
        assert [p for _, p in L.cut_text(text, size, overlap)] == _plain_chunks(text, size, overlap), (text, size, overlap)


def test_a_break_that_begins_before_the_look_back_does_not_count():
    a, b, c = "a" * 799, "b" * 99, "c" * 400
    assert [(i, len(p)) for i, p in L.cut_text(f"{a}\n\n{b}. {c}")][0] == (0, 901)  # up to the sentence's end
    assert [(i, len(p)) for i, p in L.cut_text(f"{a}x\n\n{b}. {c}")][0] == (0, 800)  # the blank line lies in the window
    assert L.cut_text("z" * 799 + ". " + "z" * 400)[0] == (0, "z" * 799 + ".")  # of the sentence's end only the space counts, at the same place
    assert [p for _, p in L.cut_text("word\u2028next\u3000last " * 3, 11, 0)][0] == "word\u2028next"


def test_query_of_chunks(spark, sf):
    """chunk_text against the plain rule, on all documents."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["chunk_text"](spark, sf).collect():
        got.setdefault(r["id"], []).append((r["ordinal"], r["content"]))
        assert texts[r["id"]][r["start"] :].startswith(r["content"])
    for i, own in got.items():
        assert [c for _, c in sorted(own)] == _plain_chunks(texts[i], L.CHUNK, L.OVERLAP)


def test_projection_against_numpy_up_to_signs(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    x = {r["id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = sorted(x)
    centred = np.stack([x[i] for i in ids]) - np.mean([x[i] for i in ids], 0)
    _, scale, axes = np.linalg.svd(centred, full_matrices=False)
    assert min(scale[:2] - scale[1:3]) > 1e-3
    got = {r["id"]: [r["x"], r["y"], r["z"]] for r in G.project_3d(rows).collect()}
    want = centred @ axes[:3].T
    for k in range(3):
        own = np.array([got[i][k] for i in ids])
        assert min(abs(own - want[:, k]).max(), abs(own + want[:, k]).max()) < 1e-6


def test_clusters_of_documents(spark):
    """Two topics of six documents each; a document without a vector is in none."""
    rng = np.random.default_rng(1)
    rows = [(d, [float(v) for v in rng.normal(0 if d < 6 else 20, 0.05, 4)]) for d in range(12) for _ in range(3)] + [(99, None)]
    found = B.cluster_documents(spark.createDataFrame(rows, "document long, embedding array<float>"), k=2).collect()
    of = {r["id"]: r["cluster"] for r in found}
    assert sorted(of) == list(range(12))
    again = B.cluster_documents(spark.createDataFrame(rows, "document long, embedding array<float>"))
    assert {r["id"] for r in again.collect()} == set(range(12))


def test_a_turn_with_many_chunks_gives_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 100)
    turns = spark.range(1001).selectExpr("1 AS turn", "id AS chunk", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts")
    turns = turns.union(turns.limit(3)).union(spark.sql("SELECT 2, 5L, timestamp'2025-01-01' UNION ALL SELECT 2, 7L, timestamp'2025-01-02' UNION ALL SELECT 3, 5L, timestamp'2026-01-01'"))
    edges = G.co_retrieval(turns)
    assert edges.count() == 1001 * 1000 // 2 and edges.where("a < b AND turns = 1 AND last = timestamp'2024-01-01 00:16:40'").count() == 1001 * 1000 // 2 - 1
    one = edges.where("a = 5 AND b = 7").first()
    assert (one["weight"], one["turns"], str(one["last"])) == (2.0, 2, "2025-01-02 00:00:00")


def test_what_names_nothing_is_a_bare_request(spark):
    asked = ["can you explain", "please tell me about my documents", "what is it", "what is entropy", "explain", "please", "please entropy", "what about them", "explain the image now", "summarize my files", ""]
    pattern = re.compile(f"^(?:(?:{'|'.join(T.POLITE)}) )?(?:{'|'.join(T.REQUESTS)})(?: (?:{'|'.join(T.NOTHING)}))?$")
    got = {r["q"]: r["b"] for r in spark.createDataFrame([(q,) for q in asked], "q string").select("q", T.bare_request(F.col("q")).alias("b")).collect()}
    assert got == {q: bool(pattern.match(q)) for q in asked}


def test_labels_of_types_that_are_none(spark):
    rows = spark.createDataFrame([("application/pdf",), ("application/zip",), ("broken",), ("x/",), (None,)], "m string")
    assert [r[0] for r in rows.select(scalars.type_label(F.col("m"))).collect()] == ["PDF", "ZIP", "FILE", "FILE", "FILE"]


def test_region_types_of_the_evaluation_set(spark):
    """The visual types are among those that a set of questions asks for: nothing is left of the difference."""
    asked = spark.createDataFrame([("paragraph",), ("chart",), ("table",), ("image",), ("caption",)], "t string").agg(F.collect_set("t").alias("t"))
    assert asked.select(F.array_except(F.array(F.lit("image"), F.lit("chart"), F.lit("table")), "t")).first()[0] == []


def test_letters_of_all_scripts_are_words(spark):
    got = spark.createDataFrame([("Größe, l'été — 漢字 a1b",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert got == ["größe", "l", "été", "漢字", "a", "b"]
