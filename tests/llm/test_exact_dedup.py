import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm import exact_dedup as X


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(_norm(r["text"]), []).append(r["doc_id"])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((r["doc_id"], least[k := _norm(r["text"])], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for r in rows), key=str)


def test_against_brute_force(spark, sf, awkward):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        found = X.exact_groups(df).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == _brute(df.collect())
        kept = [r for r in found if r["kept"]]
        assert len(kept) == len({r["text_sha256"] for r in found}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_filter_of_few_bits_changes_nothing(spark, awkward):
    good = sorted(map(str, X.exact_groups(awkward).collect()))
    assert sorted(map(str, X.exact_groups(awkward, bits_per_row=1, max_filter_bits=X.BLOCK_BITS).collect())) == good


def test_the_filter_has_no_false_negative_and_few_false_positives(spark):
    df = spark.range(40_000).select(F.sha2((F.col("id") - F.when(F.col("id") < 200, F.col("id") % 2).otherwise(0)).cast("string"), 256).alias("sha"))
    flagged = X.may_repeat(df, "sha", X.repeated_filter(df, 40_000), "maybe").where("maybe")
    repeated = df.groupBy("sha").count().where("count > 1")
    assert repeated.count() == 100 and flagged.join(repeated, "sha").count() == 200
    assert flagged.count() < 200 + 40_000 // 20


def test_rows_that_the_filter_clears_are_not_shuffled(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = X.drop_copies(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_drop_copies_keeps_columns_and_one_row_a_text(awkward, empty):
    out = X.drop_copies(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert len(rows) == len({_norm(r["text"]) for r in awkward.collect()})
    assert {r["doc_id"] for r in rows} >= {1, 3, 6, 7, 8} and 2 not in {r["doc_id"] for r in rows}
    assert X.drop_copies(empty).count() == 0 and X.exact_groups(empty).count() == 0


def test_a_million_copies_without_an_id(spark):
    """One text and no id in a million rows: all come out, one is kept, and no row is made of many."""
    df = spark.range(1_000_000).selectExpr("cast(null AS long) AS doc_id", "'same text' AS text").unionByName(spark.createDataFrame([(7, "other")], "doc_id long, text string"))
    rows = X.exact_groups(df)
    assert rows.count() == 1_000_001 and rows.where("kept").count() == 2
    assert rows.where("doc_id IS NULL").agg(F.min("group_size"), F.max("group_size")).first()[:] == (1_000_000, 1_000_000)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_repeated_ids_across_groups(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "a  b"), (1, "c\td"), (None, "c d")], "doc_id long, text string")
    rows = X.exact_groups(df).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in rows) == [("1", 1, 2), ("1", 1, 3), ("1", 1, 3), ("2", 1, 2), ("None", 1, 3)]
    assert sum(r["kept"] for r in rows) == 2
    assert sorted(r["text"] in ("a b", "a  b") for r in X.drop_copies(df).collect()) == [False, True]
