import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import _chains
from tessera.llm import language_id as L
from tessera.llm.queries import op5_language_id

WORDS = {"aa": ["bado", "dobi", "gabu", "badabo", "gido"], "bb": ["plin", "trels", "skrin", "pelst", "tink"], "cc": ["mwa", "nyo", "njia", "mwana", "ngoma"]}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    right = []
    for r in rows:
        t = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if t["text"] is None or not re.search(r"[^\W\d_]", t["text"]):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and t["lang"] is not None:
            right.append(r["lang_pred"] == t["lang"])
    assert len(right) > 100 and np.mean(right) > 0.97


def test_labels_of_code_switched_text():
    rng = random.Random(2)
    tagger = L.fit([(lang, _text(rng, lang, 20)) for lang in WORDS for _ in range(60)], L.Settings())
    text = pa.array([_text(rng, "aa", 40) + " " + _text(rng, "bb", 25) + " " + _text(rng, "cc", 10)])
    [g] = list(L._judged(tagger, text))
    assert tagger.labels[g.best[0]] == "aa" and g.words.counts[0] == 75 and len(g.begins) == 3 and abs(g.score[0] - 40 / 75) < 0.05
    assert np.diag(tagger.moves).min() > (tagger.moves - np.diag([9.0] * 3)).max()  # staying is learned


def test_posteriors_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    t = L.Tagger(["a", "b"], np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores, first = rng.normal(size=(7, 2)), np.array([0, 4, 7])
    lay = _chains.layout(first)
    p = np.empty((7, 2))
    p[lay.at] = L._posteriors(t, lay, scores)[0]
    for lo, hi in ((0, 4), (4, 7)):
        want = np.zeros((hi - lo, 2))
        for path in product((0, 1), repeat=hi - lo):
            w = math.exp(t.start[path[0]] + sum(scores[lo + i, y] for i, y in enumerate(path)) + sum(t.moves[path[i - 1], path[i]] for i in range(1, hi - lo)))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(p[lo:hi], want / want.sum(1, keepdims=True))


def _plain(t, text):
    """lang_pred, score, words, and the words' labels and posteriors, by plain loops over one whole text."""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    emitted = []
    for w in words:
        at_bytes, at_words, _ = L._grams(L._words.split(*L._words.raw(pa.array([w.decode()]))))
        emitted.append(np.exp((t.weights[at_bytes].sum((0, 1)) + t.weights[at_words].sum((0, 1))).astype(float)))
    k, move, ahead = len(t.labels), np.exp(t.moves), [np.exp(t.start)]
    for e in emitted:
        a = ahead[-1] * e if len(ahead) == 1 else (ahead[-1] @ move) * e
        ahead.append(a / a.sum())
    behind, p = np.ones(k), []
    for i in range(len(words) - 1, -1, -1):
        x = ahead[i + 1] * behind
        p.insert(0, x / x.sum())
        behind = move @ (emitted[i] * behind)
        behind /= behind.sum()
    lettered = [x for x, w in zip(p, words, strict=True) if re.search(rb"[A-Za-z\x80-\xff]", w)]
    if not lettered or not re.search(r"[^\W\d_]", text):
        return "und", 0.0, len(words), p
    mean = np.mean(lettered, 0)
    return t.labels[int(mean.argmax())], float(mean.max()), len(words), p


def test_query_against_plain_loops(spark, sf):
    """op5 with the weights that it learns, and its word labels, against a loop over each whole text's words; long texts too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    tagger = L.train(docs.where(~L.held_out(F.col("doc_id"))).select("text", "lang"), L.Settings())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert max(len((t or "").split()) for t in texts.values()) > 300
    runs = {}
    for r in L.label_runs(docs, tagger, ["doc_id"]).collect():
        runs.setdefault(r["doc_id"], []).append(r)
    for r in op5_language_id(spark, sf).collect():
        lang, score, n, p = _plain(tagger, texts[r["doc_id"]])
        assert (r["lang_pred"], r["n_words"]) == (lang, n) and abs(r["score"] - score) < 1e-4
        own, at = sorted(runs.get(r["doc_id"], []), key=lambda x: x["run"]), 0
        for k, x in enumerate(own):
            assert (x["run"], x["first_word"]) == (k, at)
            at = x["last_word"] + 1
            for q in p[x["first_word"] : at]:
                assert q[tagger.labels.index(x["lang_pred"])] > q.max() - 1e-4
            assert abs(x["score"] - np.mean([q.max() for q in p[x["first_word"] : at]])) < 1e-4
        assert at == n and r["switches"] == max(0, len(own) - 1)


def test_a_chain_is_not_cut(spark):
    """Where the words say nothing for 400 words, the label at their beginning holds to their end."""
    rng = random.Random(2)
    tagger = L.fit([(lang, _text(rng, lang, 20)) for lang in WORDS for _ in range(60)], L.Settings())
    tagger.moves = np.diag([30.0] * 3)
    text = _text(rng, "bb", 3) + " 0" * 400
    [g] = list(L._judged(tagger, pa.array([text])))
    assert {tagger.labels[x] for x in g.label} == {"bb"} and len(g.begins) == 1


def test_long_words_teach_their_ends(spark):
    """Words of 70 letters that differ in their last ones alone."""
    rows = [("k" * 66 + end, end) for end in ("mola", "ridu") for _ in range(3)]
    rows += [(f"{'k' * 66}{end} {i}", end) for i in range(40) for end in ("mola", "ridu")]
    tagger = L.train(spark.createDataFrame(rows, "text string, lang string"), L.Settings())
    assert [tagger.labels[x] for g in L._judged(tagger, pa.array(["k" * 66 + "mola", "k" * 66 + "ridu"])) for x in g.best] == ["mola", "ridu"]


def test_languages_beyond_the_limit_teach_nothing(spark):
    rows = [(100 * i + j, f"some words {j} of {'abcdefgh'[i] * 5}", f"l{i}") for i in range(6) for j in range(10 + 10 * (i in (1, 4)))]
    tagger = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"), L.Settings(languages=2))
    assert sorted(tagger.labels) == ["l1", "l4"]


def test_clashing_columns(spark, awkward):
    tagger = L.train(awkward.select("text", "lang"), L.Settings())
    out = L.predict(awkward, tagger, ["lang_pred", "score", "_text"])
    assert out.columns == ["lang_pred", "score", "_text", "_lang_pred", "_score", "n_words", "switches"] and {r["lang_pred"] for r in out.collect()} == {"q"}
    assert L.label_runs(awkward, tagger, ["score"]).columns == ["score", "run", "first_word", "last_word", "lang_pred", "_score"]


def test_predictions_see_the_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    tagger = L.train(docs.select("text", "lang"), L.Settings(sample_docs=50, epochs=1))
    one = L.predict(docs, tagger, [F.col("doc_id")])
    two = L.predict(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "doc_id": -F.col("doc_id")}), tagger, [(-F.col("doc_id")).alias("doc_id")])
    assert sorted(one.collect()) == sorted(two.collect())


def test_copies_do_not_fill_the_sample(spark):
    rng = random.Random(3)
    rows = [("plin plin plin", "bb")] * 400 + [(_text(rng, lang, 15), lang) for lang in WORDS for _ in range(30)]
    tagger = L.train(spark.createDataFrame(rows, "text string, lang string"), L.Settings(sample_docs=30))
    texts = pa.array([_text(rng, lang, 10) for lang in WORDS])
    best = [tagger.labels[x] for g in L._judged(tagger, texts) for x in g.best]
    assert best == list(WORDS)


def test_awkward_rows(spark, awkward, empty):
    rows = {r["doc_id"]: r for r in L.identify(awkward).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert rows[9]["lang_pred"] in ("en", "de") and rows[6]["n_words"] == 48000
    assert L.identify(empty).count() == 0
    nothing = L.identify(awkward.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert len(nothing) == awkward.count() and {r["lang_pred"] for r in nothing} == {"und"}
    one = L.identify(spark.createDataFrame([(i, "abc def" if i else "123", "xx") for i in range(20)], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in one if r["doc_id"]} == {"xx"}
    tagger = L.train(awkward.select("text", "lang"), L.Settings())
    kept = L.accept(awkward, tagger, 0.3)
    assert kept.columns == awkward.columns and not {3, 4, 5, 8} & {r["doc_id"] for r in kept.collect()}
    assert L.accept(empty, tagger, 0.3).count() == 0


def test_texts_are_accepted_without_a_language(spark):
    """No row teaches a language: the pipeline's stage keeps all texts with a letter."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string"
    rows = [(1, "some words", None), (2, "größe", None), (3, "123 !", "xx"), (4, "", None), (5, None, "yy"), (6, "漢字", None), (7, "٣", None)]
    for own in (rows, [(i, t, None) for i, t, _ in rows]):
        docs = spark.createDataFrame(own, schema)
        assert {r["doc_id"] for r in L.accept(docs, L.Tagger([], np.zeros((L.FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0)), 0.1).collect()} == {1, 2, 6}
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, spark.createDataFrame([(i, t, None) for i, t, _ in rows], schema), "").collect()} == {1, 2, 6}


def test_the_threshold_counts_from_chance(spark):
    """With two and three languages, texts that are as much in one as in another go, and clean ones stay."""
    import corpus_pipeline

    rng = random.Random(5)
    for langs in (["aa", "bb"], ["aa", "bb", "cc"]):
        mixed = " ".join(_text(rng, lang, 60) for lang in langs)
        known = [(i, _text(rng, lang, 30), lang) for i, lang in enumerate(langs * 40)]
        docs = spark.createDataFrame([*known, (1000, mixed, None), *[(1001 + k, _text(rng, lang, 40), None) for k, lang in enumerate(langs)]], "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
        assert kept == {i for i, *_ in known} | {1001 + k for k in range(len(langs))}
    assert abs(L.least_score(4, corpus_pipeline.LANGUAGE_MARGIN) - corpus_pipeline.LEAST_LANGUAGE_SCORE) < 1e-9


def test_long_texts_take_few_steps_with_the_posteriors_of_whole_chains(monkeypatch):
    rng = np.random.default_rng(8)
    for k in (1, 4, 17):  # beyond PRODUCT_LABELS without products
        first = np.cumsum([0, 3, 0, 700, 128, 129, 64, 1, 5000, 0])
        start, move, e = rng.random(k), np.exp(-9 * rng.random((k, k))), np.maximum(np.exp(-40 * rng.random((first[-1], k))), 1e-30)
        e[200:400, 0] = 1e-30
        lay = _chains.layout(first)
        want = np.empty_like(e)
        want[lay.at] = _chains.forward_backward(lay, np.broadcast_to(start, (len(first) - 1, k)), move, e[lay.at])[0]
        assert np.allclose(_chains.posteriors(first, start, move, e), want, rtol=0, atol=1e-9)
    laid, plain = [], _chains.layout
    monkeypatch.setattr(_chains, "layout", lambda f: laid.append(plain(f)) or laid[-1])
    words = random.Random(4)
    tagger = L.fit([(lang, _text(words, lang, 20)) for lang in WORDS for _ in range(9)], L.Settings())
    laid.clear()
    [g] = L._judged(tagger, pa.array([_text(words, "aa", 20_000), "bado dobi"]))
    assert g.words.counts.tolist() == [20_000, 2] and tagger.labels[g.best[0]] == "aa"
    assert sum(len(x.alive) for x in laid) < 500  # one step a word was 20,000
