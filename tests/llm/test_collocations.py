import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm._io import stash

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _grams(rows, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def _brute(rows, s):
    f, n = _grams(rows, s.most_words)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= s.least}
        over = defaultdict(int)  # the most frequent longer candidate around each phrase
        for q, b in candidates.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    over[q[i : i + k]] = max(over[q[i : i + k]], b)
        rows_ = []
        for p, a in candidates.items():
            if 100 * over[p] >= s.cover_percent * a:
                continue
            score, k = min((s.scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(rows_)[: s.top], 1)]
    return sorted(out)


@pytest.mark.parametrize("s", [C.Settings(), C.Settings(least=3, top=40), C.Settings(most_words=2, least=5), C.Settings(least=4, cover_percent=50, most_words=5)])
def test_against_brute_force(spark, sf, s):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    want = _brute([tuple(r) for r in df.collect()], s)
    assert want
    assert sorted(map(tuple, C.collocations(df, settings=s).collect())) == want


def _odd():
    rows = [("en", "a b. a  b, A\tB; c a b!d e?f\x0bg h\x0ca b\r\nx \x00y z")] * 4 + [(None, "a b a b a b")] * 3 + [("und", "a b")] * 2 + [("de", None), ("de", ""), (None, None)]
    rows += [("fr", "über straße " * 40_000), ("fr", "Über Straße"), ("", "no name no name no name"), ("en", "w" * 100_000 + " end " + "w" * 100_000 + " end")]
    return rows


def test_odd_texts(spark, empty):
    s = C.Settings(least=2)
    df = spark.createDataFrame(_odd(), "lang string, text string").withColumns({"key": F.lit(1), "words": F.lit("x"), "n": F.lit(None).cast("long"), "phrase": F.lit("p")})
    assert sorted(map(tuple, C.collocations(df, settings=s).collect())) == _brute(_odd(), s)
    counts = {(r["lang"], r["phrase"]): r["n"] for r in C.phrase_counts(df, settings=s).collect()}
    assert counts[("und", "a b")] == 11 and counts[("fr", "über straße")] == 40_000 and counts[("fr", None)] == 80_002
    assert C.collocations(empty).count() == 0


def test_clashing_names(awkward):
    s = C.Settings(least=2)
    assert sorted(map(tuple, C.collocations(awkward, settings=s).collect())) == _brute([(r["lang"], r["text"]) for r in awkward.collect()], s)


def test_a_full_filter_and_many_small_sums_change_nothing(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    s = C.Settings(least=4, max_filter_bits=C.CELLS)
    want = _brute([tuple(r) for r in df.collect()], s)
    monkeypatch.setattr(C, "FLUSH", 64)
    assert sorted(map(tuple, C.collocations(df.repartition(3), settings=s).collect())) == want


def test_the_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = stash(spark.range(20_000).select(F.xxhash64("id").alias("key")), "keys")
    f = C.Filter(keys, 1 << 28)
    held = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert f(held).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert f(other).mean() < 0.02
    assert not C.Filter(keys.limit(0), 1 << 28)(other).any()
