"""Rows' places in groups that lie in several ranges."""

from pyspark.sql import functions as F

from tessera.functions.ordering import numbered


def test_a_group_over_many_ranges_is_numbered_without_gaps(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 7 > 0, F.col("id") % 5).alias("g"), ((F.col("id") * 7919) % 30_011).alias("at"))
    out = numbered(rows, ["g"], [F.col("at").desc()], "nth")
    assert out.columns == ["g", "at", "nth"]
    held = {}
    for g, at, nth in sorted(out.collect(), key=str):
        held.setdefault(g, []).append((nth, -at))
    assert sum(map(len, held.values())) == 30_000 and None in held
    for places in held.values():
        places.sort()
        assert [n for n, _ in places] == list(range(1, len(places) + 1)) and [a for _, a in places] == sorted(a for _, a in places)


def test_odd_names_ties_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "b", 0), (1, None, 0), (None, "a", 0)], "`a b` long, _at string, _part long")
    out = numbered(rows, ["a b"], [F.col("_at").asc_nulls_first()], "n", keep=[F.col("`a b`"), F.col("_at")])
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "b", 2), (1, "b", 3), (1, None, 1), (None, "a", 1)]
    assert numbered(rows.limit(0), ["a b"], [F.col("_at")], "n").count() == 0
