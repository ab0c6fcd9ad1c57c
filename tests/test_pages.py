"""Pages from marks, over tables that change between pages."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import pages as P


def _walk(read, keys, size, after=None):
    while True:
        rows = [tuple(r) for r in P.page(read(), keys, size, after).collect()]
        yield rows
        if len(rows) < size:
            return
        after = P.mark(P.page(read(), keys, size, after), keys)


def test_nothing_is_repeated_or_lost_while_rows_come_and_go(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    ids(range(0, 100, 2)).write.parquet(f"{root}/t")
    gone: set[int] = set()
    read = lambda: spark.read.parquet(f"{root}/t").where(~F.col("id").isin([*gone, -1]))
    seen = []
    for n, rows in enumerate(_walk(read, ["id"], 7)):
        seen += [r[0] for r in rows]
        if n == 2:  # pages 0 to 2 ended at 40: new rows before and after that, and old ones go
            ids([1, 39, 41, 99]).write.mode("append").parquet(f"{root}/t")
            gone |= {0, 40, 44}
    assert seen == sorted([x for x in range(0, 100, 2) if x != 44] + [41, 99])


def test_marks_of_several_keys_go_on_anywhere(spark):
    rows = [(g, n, f"{g}{n}") for g in "abc" for n in range(5)] + [(None, 1, "x"), ("b", None, "y")]
    df = spark.createDataFrame(rows, "`a b` string, n long, page string").repartition(3)
    keys = ["a b", "n"]
    got = list(_walk(lambda: df, keys, 4))
    want = [r for r in rows if r[0] is not None and r[1] is not None]
    assert [r for p in got for r in p] == want and [len(p) for p in got] == [4, 4, 4, 3]
    assert [r for p in _walk(lambda: df, keys, 4, ("b", 1)) for r in p] == [r for r in want if r[:2] > ("b", 1)]
    all_at_once = {r["page"]: r["at"] for r in P.paged(df, keys, 4, "at").collect()}
    assert all_at_once == {r[2]: n for n, p in enumerate(got) for r in p}
    found = sorted((r["page"], tuple(r["first"]), tuple(r["last"]), r["n"]) for r in P.spans(df.withColumnRenamed("a b", "g"), ["g", "n"], 4).collect())
    assert found == [(n, p[0][:2], p[-1][:2], len(p)) for n, p in enumerate(got)]


def test_the_marks_bound_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    plan = P.page(docs, ["doc_id"], 5, (100,))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "TakeOrderedAndProject" in plan


def test_no_rows_and_wrong_calls(spark):
    df = spark.createDataFrame([], "id long, v string")
    assert P.page(df, ["id"], 5).collect() == [] and P.mark(df, ["id"]) is None
    assert P.paged(df, ["id"], 5).collect() == [] and P.spans(df, ["id"], 5).collect() == []
    with pytest.raises(ValueError):
        P.page(df, ["id"], 0)
    with pytest.raises(ValueError):
        P.page(df, ["id"], 5, (1, 2))
