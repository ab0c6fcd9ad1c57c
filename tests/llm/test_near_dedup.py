import random
import re
from itertools import combinations

import pytest

from tessera.llm import near_dedup as N
from tessera.llm.queries import op7_near_dedup


def _set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def _components(rows, k, percent=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of different sets."""
    sets = {}
    for r in rows:
        sets.setdefault(_set(r["text"], k), []).append(r["doc_id"])
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    real = [s for s in sets if s]
    for a, b in combinations(real, 2):
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        if s:
            least[find(s)] = min([i for i in (least.get(find(s)), *ids) if i is not None], default=None)
    out = []
    for r in rows:
        s = _set(r["text"], k)
        c = least[find(s)] if s else r["doc_id"]
        out.append((r["doc_id"], len(s), c, r["doc_id"] == c))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    assert _rows(op7_near_dedup(spark, sf)) == _components(spark.read.parquet(f"{sf}/documents.parquet").collect(), 4)


def _family(rng, base, n, changes):
    out = [" ".join(base)]
    for _ in range(n - 1):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("settings", [N.Settings(), N.Settings(short=2, block=8), N.Settings(shingle_words=4, short=4, block=5)])
def test_planted_families(spark, settings):
    """Families about the threshold, a large one whose postings are long, and frequent passages that link nothing."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        texts += _family(rng, [word() for _ in range(rng.randint(30, 200))], rng.randint(2, 8), 8)
    texts += _family(rng, [word() for _ in range(150)], 70, 3)
    texts += [" ".join([*shared, *(word() for _ in range(rng.randint(40, 200)))]) for _ in range(60)]
    texts += ["", "one", "one", "two words", "TWO words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _rows(N.near_groups(df, settings=settings)) == _components(df.collect(), settings.shingle_words)


def test_the_threshold_is_inclusive(spark):
    k, base = 5, [f"a{i}" for i in range(13)]  # 9 shingles
    other = [*base, "b"]  # 10 shingles, 9 shared: 0.9
    third = [*base, "b", "c", "d"]  # 12 shingles: 9/12 against base, 10/12 against other
    exact = [f"e{i}" for i in range(12)], [*(f"e{i}" for i in range(12)), "f", "g"]  # 8 of 10
    texts = [base, other, third, *exact, [*exact[0], "f", "g", "h"]]  # and 8 of 11, but 10 of 11
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = _rows(N.near_groups(df, settings=N.Settings(shingle_words=k)))
    assert rows == _components(df.collect(), k)
    assert [r[2] for r in rows] == [0, 0, 0, 3, 3, 3]


def test_awkward_rows(awkward, empty):
    rows = N.near_groups(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[3]["component_id"] == 3 and by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[10]["n_shingles"] == 1
    assert by[2]["component_id"] == 1 and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    kept = N.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and not {r["doc_id"] for r in kept.collect()} & {2, 7}
    assert N.near_groups(empty).count() == 0 and N.drop_near_copies(empty).count() == 0


def test_an_ids_other_text_stays(spark):
    """Rows (1, A), (5, near A), (5, B): B has no copy and stays; of two texts with a group's least id one stays."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (5, a + " more"), (5, b), (None, a + " and"), (None, b + " end"), (9, "c d e"), (9, "C D e"), (3, None), (3, "")], "doc_id long, text string")
    kept = sorted(str((r["doc_id"], (r["text"] or "")[:2])) for r in N.drop_near_copies(df).collect())
    assert kept in (sorted(map(str, [(1, "a0"), (5, "b0"), (9, x), (3, ""), (3, "")])) for x in ("c ", "C "))


def _one_passage(rng, n):
    """n texts of one frequent passage and an end of their own: alike in most coordinates, none a link, but for some planted pairs."""
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join([*passage, *(f"q{rng.randrange(10**9)}" for _ in range(26))]) for _ in range(n)]
    return texts, [texts[i] + f" tail{i}" for i in range(0, n, n // 20)]


def test_a_long_posting_of_many_components(spark):
    """5,000 texts that share a passage of three quarters: a posting of 5,000 components, in which each planted link is found and no other."""
    texts, copies = _one_passage(random.Random(3), 5_000)
    df = spark.createDataFrame(list(enumerate([*texts, *copies])), "doc_id long, text string").repartition(8)
    rows = {r["doc_id"]: r["component_id"] for r in N.near_groups(df).collect()}
    for k in range(5_000):
        assert rows[k] == k
    assert [rows[5_000 + k] for k in range(len(copies))] == list(range(0, 5_000, 250))


def test_neither_short_postings_nor_blocks_alter_components(spark):
    rng = random.Random(11)
    texts, copies = _one_passage(rng, 120)
    word = lambda: f"w{rng.randrange(300)}"
    for _ in range(6):
        texts += _family(rng, [word() for _ in range(rng.randint(20, 90))], 12, 6)
    df = spark.createDataFrame(list(enumerate([*texts, *copies])), "doc_id long, text string")
    want = _components(df.collect(), 5)
    for short, block in ((2, 3), (8, 1000), (1000, 4)):
        assert _rows(N.near_groups(df, settings=N.Settings(short=short, block=block))) == want
