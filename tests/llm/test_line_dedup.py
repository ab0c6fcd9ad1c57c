import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as D
from tessera.llm.queries import QUERIES

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _key(line):
    return line.strip("\x20\t\n\x0b\x0c\r").translate(UPPER)


def _brute(rows, chars=40, least=5):
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= chars:
                held[_key(line)].add(order(i))
    top = {k: max(v) for k, v in held.items() if len(v) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if top.get(_key(x), order(i)) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _digests(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=str)


def test_the_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = _digests(_brute(rows))
    assert sum(d for _, _, d, _ in want) > 0
    assert sorted(map(tuple, QUERIES["op13_line_dedup"](spark, sf).collect()), key=str) == want


LINE = "This line, of well over forty letters, stands in many documents."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"own {i}\n\t {LINE.upper() if i % 2 else LINE} \r\nshort\n{LINE}") for i in range(6)]
    rows += [(7, LINE), (7, f"{LINE}\n{LINE}\nother row of that id"), (7, LINE), (None, LINE), (None, f"a\n{LINE}"), (8, None), (9, ""), (10, "\n\n"), (11, " \x0b\x0c ")]
    rows += [(20 + i, "ÄÖÜ" * 14 + ("" if i < 4 else "\n" + "x" * 39)) for i in range(5)]  # 42 code points, capitals that stay
    rows += [(30 + i, "x" * 39) for i in range(9)] + [(40 + i, "äöü" * 14) for i in range(4)]
    rows += [(50 + i, "y" * 40 + "\n" + "z" * 200_000 + "\n" * 50_000) for i in range(5)]
    return rows


def test_odd_lines(spark, odd, empty):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    want = _brute(odd)
    assert sorted(map(tuple, D.line_report(df).collect()), key=str) == _digests(want)
    wide = df.withColumns({"keep": F.lit(1), "_key": F.lit("k"), "docs": F.lit(None).cast("string")}).select("docs", "text", "_key", "doc_id", "keep")
    out = D.drop_lines(wide)
    assert out.columns == wide.columns
    texts = sorted(((i, t) for i, _, _, t in want), key=str)
    assert sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str) == texts
    assert out.where("doc_id = 8").first()["text"] is None
    assert D.line_report(empty).count() == 0 and D.drop_lines(empty).columns == empty.columns


def test_clashing_names_and_very_long_texts(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    settings = D.Settings(least_chars=10, least_documents=2)
    assert sorted(map(tuple, D.line_report(awkward, settings=settings).collect()), key=str) == _digests(_brute(rows, 10, 2))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_a_hash_over_many_ranges(spark, partitions):
    """One line in all documents, one in five that are far apart, one in four; ranges end within them."""
    rows = [(i, "\n".join([LINE, *([f"{LINE} 5"] if i % 400 == 0 else []), *([f"{LINE} 4"] if i in (1, 700, 1300, 1999) else []), f"line of document {i} alone, and of no other one"])) for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = D.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
        assert sorted(map(tuple, out.collect()), key=str) == _digests(_brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps_are_of_all_lines(spark, odd):
    found = {(r["doc_id"], r["n_lines"]): r for r in D.line_bitmaps(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    one = found[(0, 4)]
    assert np.unpackbits(np.frombuffer(zlib.decompress(one["keep"]), np.uint8), count=4).tolist() == [1, 0, 1, 0] and one["n_dropped"] == 2
    long = found[(50, 50_002)]
    assert long["n_dropped"] == 2 and len(long["keep"]) < 200
    assert (8, 1) not in found and (54, 50_002) not in found


def test_text_ids(spark):
    rows = [(f"d{i}", f"{LINE}\n{i}") for i in range(6)]
    assert sorted(map(tuple, D.line_report(spark.createDataFrame(rows, "doc_id string, text string")).collect())) == [(f"d{i}", 2, int(i < 5), hashlib.sha256((f"{LINE}\n5" if i == 5 else str(i)).encode()).hexdigest()) for i in range(6)]
