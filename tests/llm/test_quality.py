import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import quality as Q
from tessera.llm.queries import op9_quality


def test_against_brute_force(spark, sf):
    """Rates and posteriors follow from the evidence by plain sums."""
    sf = sf.replace("sf0.001", "sf0.01")
    rows = op9_quality(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sorted(docs) == sorted(r["doc_id"] for r in rows)
    logit = lambda p: np.log(p / (1 - p))
    train = [r for r in rows if r["label"] is not None and not r["held_out"]]
    rate = (sum(r["label"] for r in train) + 0.5) / (len(train) + 1)
    groups = defaultdict(lambda: np.zeros(4))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["label"] == labels.get(r["doc_id"])
        assert r["host"] == (docs[r["doc_id"]]["source"] or "") and r["path"] == (docs[r["doc_id"]]["lang"] or "")
        used = r["label"] is not None and not r["held_out"]
        expected = 1 / (1 + np.exp(-(r["evidence"] + logit(rate))))
        own = np.array([1, r["label"], 1, r["label"]]) if used else np.array([0.25, 0.25 * expected, 0, 0])
        groups[r["host"], r["path"]] += own
    hosts = defaultdict(lambda: np.zeros(4))
    for (h, _), x in groups.items():
        hosts[h] += x

    def strength(items):
        items = [(n, y, p) for n, y, p in items if n > 1]
        top = sum(n * (y / n - p) ** 2 for n, y, p in items) - sum(p * (1 - p) for *_, p in items)
        rho = top / sum(p * (1 - p) * (n - 1) for n, _, p in items)
        return 1000.0 if rho <= 0 else min(1000.0, max(1.0, 1 / rho - 1))

    a = strength([(x[2], x[3], rate) for x in hosts.values()])
    host_rate = {h: (x[1] + a * rate) / (x[0] + a) for h, x in hosts.items()}
    b = strength([(x[2], x[3], host_rate[h]) for (h, _), x in groups.items()])
    for r in rows:
        x = groups[r["host"], r["path"]]
        path_rate = (x[1] + b * host_rate[r["host"]]) / (x[0] + b)
        assert np.isclose(r["host_rate"], host_rate[r["host"]]) and np.isclose(r["path_rate"], path_rate)
        score = 1 / (1 + np.exp(-(logit(path_rate) + r["evidence"])))
        assert np.isclose(r["score"], score) and r["kept"] == (r["score"] >= 0.5)


def test_held_out_accuracy(spark, sf):
    rows = [r for r in op9_quality(spark, sf.replace("sf0.001", "sf0.01")).collect() if r["held_out"] and r["label"] is not None]
    assert np.mean([r["kept"] == bool(r["label"]) for r in rows]) > 0.9


def test_sparse_sites_shrink_and_large_ones_do_not(spark):
    rows, labels = [], []
    for i in range(400):
        host = "good" if i < 200 else "bad"
        rows.append((i, "same text everywhere", host, "p"))
        labels.append((i, int(host == "good"), 0))
    rows.append((1000, "same text everywhere", "tiny", "p"))
    labels.append((1000, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r["host"]: r for r in Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert out["good"]["path_rate"] > 0.85 and out["bad"]["path_rate"] < 0.15 and 0.1 < out["tiny"]["path_rate"] < 0.6


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None), (7, 1), (999, 1)], "doc_id long, quality int")
    rows = Q.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["label"] for r in rows if r["doc_id"] == 1} == {1}
    kept = Q.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    good = {(r["doc_id"], r["host"], r["path"]) for r in rows if r["kept"] and r["doc_id"] != 1}
    assert good == {(r["doc_id"], r["source"] or "", r["lang"] or "") for r in kept.collect() if r["doc_id"] != 1}
    none = labels.where("false")
    assert {r["evidence"] for r in Q.classify(awkward, none).collect()} == {0.0}
    assert Q.classify(empty, labels).count() == 0 and Q.keep_good(empty, none).count() == 0


def test_words_are_evidence(spark):
    """Texts of one shape that differ in their words alone: held-out ones are told apart."""
    import random

    rng = random.Random(4)
    words = {1: [f"good{i}" for i in range(200)], 0: [f"poor{i}" for i in range(200)]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(30)), "s", "p") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    held = [r for r in Q.classify(df, labels).collect() if r["held_out"]]
    assert len(held) > 80 and all(r["kept"] == bool(r["label"]) for r in held)


def test_rows_of_one_id_are_judged_each(spark):
    rows = [(i, "good words of a quiet page that reads well." if i % 2 else "!!! $$$ 123 !!! ###", f"s{i % 2}", "p") for i in range(200)]
    rows += [(1000, "good words of a quiet page that reads well.", "s1", "p"), (1000, "!!! $$$ 123 !!! ###", "s0", "p"), (None, "!!! $$$ 123 !!! ###", "s0", "p"), (None, "good words of a quiet page that reads well.", "s1", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = Q.keep_good(df, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")).collect()
    assert len(kept) == 102 and all(r["source"] == "s1" for r in kept)
