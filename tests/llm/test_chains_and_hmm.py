import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import _chains, _words
from tessera.llm import hmm_lm as H
from tessera.llm.queries import op3_hmm_lm


def _random_model(k=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return H.Model(norm(rng.random((2, k))), norm(rng.random((k, k))), norm(rng.random((k, classes))))


def _paths(m, seq, start):
    """The likelihood by summing over all paths, and the posterior of each state and move."""
    from itertools import product

    k, total = len(m.move), 0.0
    post, moves = np.zeros((len(seq), k)), np.zeros((k, k))
    for path in product(range(k), repeat=len(seq)):
        p = m.start[start][path[0]] * m.emit[path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[path[t], seq[t]]
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
            if t:
                moves[path[t - 1], s] += p
    return total, post / total, moves / total


def test_forward_and_counts_against_all_paths():
    m, rng = _random_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n) for n in (4, 1, 6, 2)]
    tokens, first = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    brute = [_paths(m, s, 0) for s in seqs]
    assert np.allclose(H.forward(m, tokens, first), [math.log(p) for p, *_ in brute])
    later = np.array([False, True, True, False])
    starts, moves, emissions, ll = H.expected(m, tokens, first, later)
    brute = [_paths(m, s, int(x)) for s, x in zip(seqs, later, strict=True)]
    assert math.isclose(ll, sum(math.log(p) for p, *_ in brute))
    assert np.allclose(moves, sum(b[2] for b in brute))
    assert np.allclose(starts, [sum(b[1][0] for b, x in zip(brute, later, strict=True) if x == y) for y in (False, True)])
    want = np.zeros((3, 5))
    for s, b in zip(seqs, brute, strict=True):
        for t, x in enumerate(s):
            want[:, x] += b[1][t]
    assert np.allclose(emissions, want)


def test_layout_of_nothing():
    lay = _chains.layout(np.array([0]))
    assert len(lay.at) == 0


def test_words_against_a_pattern():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aB \t\n\x0b\x1cé漢 "), rng.integers(0, 30))) for _ in range(500)]
    w = _words.split(*_words.raw(pa.array([*texts, None])))
    found = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert found == [x for t in want for x in t] and w.counts.tolist() == [*map(len, want), 0]
    h = _words.fingerprints(w)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in found]
    assert len(set(h.tolist())) == len(set(lower)) and len(set(zip(lower, h.tolist(), strict=True))) == len(set(lower))


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.mark.parametrize("frequent", [1 << 17, 50])
def test_base_against_brute_force(spark, sf, frequent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in H.score_texts(docs, settings=H.Settings(frequent_words=frequent, own_classes=40, iterations=2)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts)
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(t for i, x in texts.items() if not out[i] for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, text in texts.items():
        tokens, r = _tokens(text), rows[i]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(tokens), sum(t in counts for t in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0


def test_the_model_beats_its_base_on_held_out_texts(spark, sf):
    rows = [r for r in op3_hmm_lm(spark, sf.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_add_up(spark):
    """Over all texts of up to two tokens of a tiny vocabulary, with one unseen word, probabilities fit below one and the classes' masses sum to one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb aa", "bb cc", "aa cc dd", "aa", "bb bb"])], "doc_id long, text string")
    s = H.Settings(states=2, own_classes=2, iterations=3)
    v = H.vocabulary(H.count_words(df), s)
    words = ["aa", "bb", "cc", "dd"]
    known = (sum(Counter(t for x in df.collect() for t in _tokens(x["text"])).values()), 5)
    assert (v.tokens, v.distinct) == known
    out = {r["text"]: r for r in H.score_texts(df.unionByName(spark.createDataFrame([(100 + i, w) for i, w in enumerate([*words, ""])], "doc_id long, text string")), folds=10**9, settings=s).join(spark.createDataFrame([(100 + i, w) for i, w in enumerate([*words, ""])], "doc_id long, text string"), "doc_id").collect()}
    assert 0 < sum(10 ** r["score"] for r in out.values()) < 1


def test_awkward_rows(awkward, empty):
    rows = H.score_texts(awkward).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[3]["score"] == by[4]["score"]
    assert by[6]["n_tokens"] == 48001 and not by[None]["held_out"]
    assert H.score_texts(empty).count() == 0


def test_without_training_rows(spark):
    df = spark.createDataFrame([(i, "some words") for i in range(5)], "doc_id long, text string")
    rows = H.score_texts(df, folds=1).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows) and len(rows) == 5


def test_the_querys_scores_against_plain_loops(spark, sf):
    """The score of whole texts by a plain forward recursion in logarithms, and by each word's share of its class."""
    from pyspark.sql import functions as F

    docs, s = spark.read.parquet(f"{sf}/documents.parquet"), H.Settings()
    counts = H.stash(H.count_words(docs.where(~H.held_out(F.col("doc_id")))), "counts")
    v = H.vocabulary(counts, s)
    encoded = H.stash(docs.select("doc_id", F.lit(0).cast("long").alias("row"), H.held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(H._encode(v, H.pa.int64()), "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, within double, seq binary, rare binary, rare_suffix binary"), "encoded")
    m, _ = H.baum_welch(encoded.where("not held_out"), v, s)
    n = {np.uint64(r["word"] & (2**64 - 1)): r["n"] for r in counts.collect()}
    own = {w: c for w, c in zip(v.word.tolist(), v.own.tolist(), strict=True) if c >= 0}
    got = {r["doc_id"]: r["score"] for r in op3_hmm_lm(spark, sf).collect()}
    with np.errstate(divide="ignore"):
        start, move, emit = np.log(m.start[0]), np.log(m.move), np.log(m.emit)
    for r in docs.collect():
        w = _words.split(*_words.raw(H.pa.array([r["text"] or ""])))
        words, suffix = _words.fingerprints(w), H._suffix(w) if len(w.start) else []
        a, within = None, 0.0
        for k, (word, x) in enumerate([*zip(words.tolist(), suffix, strict=True), (0, None)]):
            c = 0 if x is None else own.get(word, 1 + int(x))
            a = start + emit[:, c] if k == 0 else np.logaddexp.reduce(a[:, None] + move, 0) + emit[:, c]
            if x is not None and word not in own:
                within += math.log10((n.get(np.uint64(word), 0) + v.add) / v.total) - math.log10(v.mass[c])
        assert abs(got[r["doc_id"]] - (np.logaddexp.reduce(a) / math.log(10) + within)) < 1e-6 * max(1, len(words))


def test_words_of_their_own_do_not_hang_on_the_broadcast_list(spark):
    """300 equally frequent words have 300 classes of their own, whether the list of frequent words has room for them or not."""
    text = " ".join(f"w{i}" for i in range(300))
    counts = H.count_words(spark.createDataFrame([(text,)] * 5, "text string")).cache()
    for room in (1, 299, 300, 1 << 17):
        v = H.vocabulary(counts, H.Settings(frequent_words=room))
        assert (v.own >= 0).sum() == 300 and len(v.word) == 300
    assert (H.vocabulary(counts, H.Settings(own_classes=20)).own >= 0).sum() == 20
