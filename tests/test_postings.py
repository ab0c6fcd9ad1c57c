"""The inverted index, stems and the positional rank against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions.stemming import STOP_WORDS, stem
from tessera.operators import postings as P
from tessera.operators import search as S
from tessera.sources.scratch import new_path

# Words and stems that the algorithm's description lists.
SAMPLE = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist,
consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid,
consoling consol, consolingly consol, consols consol, consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci,
conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel,
knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive,
knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot,
skies sky, dying die, news news, cries cri, ties tie, gas gas, this this, gaps gap, hopping hop, hoping hope, say say, happy happi, agreed agre, inning inning, generation generat, generic generic, ü ü, größe größe
"""


def test_the_published_sample():
    for pair in re.split(r",\s*", SAMPLE.strip()):
        word, want = pair.split()
        assert stem(word) == want, word
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127


WORDS = "alpha beta gamma delta the seal sealed files file rare running runs run of".split()


def _documents(n=400, seed=3):
    rng = random.Random(seed)
    return [(i * 7, None if i % 97 == 5 else " ".join(rng.choices(WORDS, weights=[9, 7, 5, 3, 9, 1, 1, 1, 1, 0.1, 1, 1, 1, 5], k=rng.randrange(0, 40))) + ("!" if i % 3 else " x1y")) for i in range(n)]


ASKED = [
    (1, "alpha beta"), (2, "alpha -beta"), (3, '"alpha beta" gamma'), (4, 'rare OR "gamma delta"'), (5, '-"the seal" the'), (6, "sealed files"), (7, "nowhere alpha"), (8, "the"), (9, None), (10, ""),
    (11, "alpha alpha beta or delta -gamma or rare"), (12, "-only"), (13, '"alpha the beta"'), (14, '"seal of file"'),
]


def _tokens(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def _plain(documents, form=None):
    """{(qid, id): (score, positional rank)} by lists of tokens."""
    out = {}
    of = lambda w: form(w) if form else w
    for qid, question in ASKED:
        alts = []
        for a in S.web_query(question or ""):
            wanted, unwanted = ([[of(w) for w in p] for p in ps if any(map(of, p))] for ps in (a.wanted, a.unwanted))
            if wanted:
                alts.append((wanted, unwanted))
        words = sorted({w for wanted, _ in alts for p in wanted for w in p if w})
        for i, text in documents:
            held = [of(w) for w in _tokens(text)]
            has = lambda p: any(all(w is None or held[s + k] == w for k, w in enumerate(p)) for s in range(len(held) - len(p) + 1))
            if not any(all(has(p) for p in w) and not any(has(p) for p in u) for w, u in alts):
                continue
            places = {w: [k for k, x in enumerate(held, 1) if x == w] for w in words}
            if len(alts) == 1 and len(words) > 1:
                rank = 1.0
                for x in words:
                    for y in words:
                        if x < y:
                            for p in places[x]:
                                for q in places[y]:
                                    d = abs(p - q)
                                    rank *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
                rank = 1 - rank
            else:
                rank = sum(0.1 / (n * n) for w in words for n in range(1, len(places[w]) + 1)) / 1.64493406685 / len(words)
            out[(qid, i)] = (round(sum(math.log1p(len(v)) for v in places.values()), 6), round(rank, 6))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(_documents(), "id long, text string"), spark.createDataFrame(ASKED, "qid long, text string")


def test_all_kinds_of_questions(spark, tables):
    docs, asked = tables
    want = _plain(_documents())
    assert {q for q, _ in want} >= {1, 2, 3, 4, 5, 6, 8, 11, 13}
    assert {(r["qid"], r["id"]): round(r["score"], 6) for r in S.matching(docs, asked).collect()} == {k: s for k, (s, _) in want.items()}
    found = {(r["qid"], r["id"]): r["rank"] for r in S.ranked_search(docs, asked).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k][1]) < 2e-6 for k in found)


def test_stems_and_stop_words(spark, tables):
    docs, asked = tables
    want = _plain(_documents(), S.english)
    found = {(r["qid"], r["id"]): r["rank"] for r in S.ranked_search(docs, asked, in_english=True).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k][1]) < 2e-6 for k in found)
    assert len([k for k in found if k[0] == 6]) > len([k for k in _plain(_documents()) if k[0] == 6])
    assert not [k for k in found if k[0] == 8] and [k for k in found if k[0] == 14]  # stop words alone ask for nothing, within a phrase they hold a place


@pytest.mark.parametrize(("block", "first", "k"), [(1024, 4, 20), (64, 1, 3), (16, 2, 1)])
def test_the_index_gives_the_same_and_ends_early(spark, tables, monkeypatch, block, first, k):
    monkeypatch.setattr(P, "BLOCK_IDS", block)
    monkeypatch.setattr(P, "FIRST_BLOCKS", first)
    docs, asked = tables
    index = P.build_index(docs, new_path(spark, "index"))
    all_of = {(r["qid"], r["id"]): r["score"] for r in P.match_index(index, S.parsed(asked)).collect()}
    assert all_of == {(r["qid"], r["id"]): r["score"] for r in S.matching(docs, asked).collect()}
    want = []
    for q in {q for q, _ in all_of}:
        best = sorted((-s, i) for (x, i), s in all_of.items() if x == q)[:k]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    assert sorted((r["qid"], r["id"], r["rank"]) for r in P.top_matches(index, S.parsed(asked), k).collect()) == sorted(want)


def test_an_index_reads_the_asked_words_only(spark, tables):
    docs, asked = tables
    index = P.build_index(docs, new_path(spark, "index"))
    terms = spark.createDataFrame([("rare",)], "term string")
    own = index.of(terms)
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in own.postings._jdf.queryExecution().toString() or "In(term" in own.postings._jdf.queryExecution().toString()
    assert {r["term"] for r in own.postings.collect()} == {"rare"}


def test_pairs_of_many_places_add_up_as_few_do():
    rng = np.random.default_rng(5)
    a, b = rng.choice(5000, 700, replace=False), rng.choice(5000, 300, replace=False)
    a = np.setdiff1d(a, b)
    d = np.abs(a[:, None] - b)
    want = np.log1p(-0.1 * np.sqrt(np.where(d > 100, 1e-30, 1 / (1.005 + 0.05 * np.exp(np.minimum(d, 100) / 1.5 - 2))))).sum()
    assert abs(P.apart(a, b) - want) < 1e-9 and abs(P.apart(b, a) - want) < 1e-9
    assert abs(P.apart(a[:20], b[:20]) - np.log1p(-0.1 * np.sqrt(P.closeness(d[:20, :20]))).sum()) < 1e-12


def test_words_are_stemmed_once_however_often_they_occur(spark, tables):
    terms = spark.createDataFrame([("seal",), ("file",)], "term string")
    forms = S.english_forms(tables[0]).join(terms, "term", "left_semi")
    assert {(r["word"], r["term"]) for r in forms.collect()} == {("seal", "seal"), ("sealed", "seal"), ("file", "file"), ("files", "file")}
    assert "Generate" not in forms._jdf.queryExecution().optimizedPlan().toString()  # stems were made of all occurrences


def test_tokens_are_grouped_where_texts_are_read(spark, tables):
    docs, _ = tables
    rows = P.postings(docs, places=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()  # every token was shuffled
    want = {(w, i): [n for n, x in enumerate(_tokens(t), 1) if x == w] for i, t in _documents() for w in _tokens(t)}
    assert {(r["term"], r["id"]): (r["tf"], r["places"]) for r in rows.collect()} == {k: (len(v), v) for k, v in want.items()}
    twice = P.postings(docs.unionByName(docs), places=True)  # an id that comes twice still has one row a word
    assert {(r["term"], r["id"]): (r["tf"], r["places"]) for r in twice.collect()} == {k: (2 * len(v), sorted(v + v)) for k, v in want.items()}
    assert twice.count() == rows.count() == len(want)


@pytest.mark.parametrize("limit", [1, 3, 500_000])
def test_slices_of_tokens_keep_rows_whole(monkeypatch, limit):
    monkeypatch.setattr(P, "SLICE_TOKENS", limit)
    tokens = [["x"], ["a", "b", "a", "a"], None, [], ["b"], ["c", "a"], [], ["b", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([9, 5, 6, 7, 5, 8, 1, 2]), pa.array(tokens, pa.list_(pa.string()))], ["id", "tokens"]).slice(1)
    rows = sorted((r["term"], r["id"], r["tf"], r["places"]) for b in P._with_places([batch]) for r in b.to_pylist())
    assert rows == [("a", 5, 3, [1, 3, 4]), ("a", 8, 1, [2]), ("b", 2, 2, [1, 2]), ("b", 5, 1, [1]), ("b", 5, 1, [2]), ("c", 8, 1, [1])]
    assert list(P._with_places([batch.slice(0, 0)])) == []


def test_only_postings_of_candidates_are_looked_at(spark, tables):
    docs, _ = tables
    asked = P.Asked.of(S.parsed(spark.createDataFrame([(1, "the rare of")], "qid long, text string")))
    fit, near = P.fitting(P.postings_for(docs, asked), asked)
    held = {i: set(_tokens(t)) for i, t in _documents()}
    assert {r["id"] for r in near.collect()} == {i for i, words in held.items() if "rare" in words}  # all of "the" and "of" were shuffled
    assert {r["id"] for r in fit.collect()} == {i for i, words in held.items() if {"rare", "the", "of"} <= words}
