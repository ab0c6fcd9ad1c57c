from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm.queries import MIX, op2_mixing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 400), min_size=1, max_size=12))
def test_a_period_keeps_every_stream_within_a_block(weights):
    share = M.shares({s: float(w) for s, w in weights.items()}, 1000)
    assert sum(share.values()) == 1000 and min(share.values()) >= 1
    slots, seen = M.one_period(share), Counter()
    for t, s in enumerate(slots, 1):
        seen[s] += 1
        for x, n in share.items():
            assert abs(seen[x] - Fraction(n * t, 1000)) < 1
    assert seen == share


def test_phases_share_out_what_ends():
    blocks = {"a": 700, "b": 20, "c": 90}
    plan = M.phases(blocks, M.Settings(weights={"a": 0.5, "b": 0.3, "c": 0.2}, period=10))
    done = Counter()
    for p, after in zip(plan, [*plan[1:], None], strict=True):
        for s in p.share:
            assert p.first[s] == done[s]
            done[s] = p.end[s]
        if after:
            assert after.base - p.base == sum(p.end[s] - p.first[s] for s in p.share)
            assert any(done[s] == blocks[s] for s in p.share)
    assert done == blocks


def _check(rows, docs, s, sizes):
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d["doc_id"]) for d in docs)
    by_stream = defaultdict(list)
    for r in rows:
        by_stream[r["stream"]].append(r)
    slots = {}
    for x, own in by_stream.items():
        at = 0
        for r in sorted(own, key=lambda r: (r["start"], sizes(r) > 0, r["hash"])):
            assert r["start"] == at
            at += sizes(r)
        for r in own:
            assert r["block"] == min(r["start"] // s.block_bytes, max(1, -(-at // s.block_bytes)) - 1)
            assert r["release"] <= r["slot"] < r["deadline"]
            assert slots.setdefault(r["slot"], (x, r["block"])) == (x, r["block"])


def test_query_against_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {d["doc_id"]: len((d["text"] or "").encode()) for d in docs}
    rows = op2_mixing(spark, sf).collect()
    _check(rows, docs, MIX, lambda r: texts[r["doc_id"]])
    named = {d["doc_id"]: d["source"] if d["source"] in MIX.weights else "*" for d in docs}
    assert all(r["stream"] == named[r["doc_id"]] for r in rows)


def test_deviation_of_the_mix(spark, sf):
    """While all streams last, after every slot each has had its share of the blocks, within one."""
    s = M.Settings(weights={"src0": 0.5, "src1": 0.2}, rest=0.3, block_bytes=512)
    rows = M.mix(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], settings=s).collect()
    first = [r for r in rows if r["phase"] == 0]
    last = {x: max(r["block"] for r in first if r["stream"] == x) for x in ("src0", "src1", "*")}
    plan = M.phases({x: 1 + max(r["block"] for r in rows if r["stream"] == x) for x in last}, s)
    seen = Counter()
    for t in range(plan[0].base, plan[1].base if len(plan) > 1 else 1):
        [x] = [x for x in last if t % 1000 in plan[0].slots[x]]
        seen[x] += 1
        assert all(abs(seen[y] - w * (t + 1)) < 1 for y, w in (("src0", 0.5), ("src1", 0.2), ("*", 0.3)))
    for r in first:
        n = r["block"]
        assert r["slot"] == n // plan[0].share[r["stream"]] * 1000 + plan[0].slots[r["stream"]][n % plan[0].share[r["stream"]]]


def test_awkward_rows(spark, awkward, empty):
    s = M.Settings(weights={"src0": 0.5, "src1": 0.5, "never": 0.1}, rest=0.0, block_bytes=64)
    rows = M.mix(awkward, ["doc_id", "text"], settings=s).collect()
    _check(rows, awkward.collect(), s, lambda r: len((r["text"] or "").encode()))
    mixed = M.mixed_order(awkward, settings=s)
    assert mixed.columns == awkward.columns and sorted(map(str, mixed.collect())) == sorted(map(str, awkward.collect()))
    order = [r["doc_id"] for r in M.mixed_order(awkward.where("doc_id < 8 AND source IS NOT NULL AND text <> ''"), settings=s).collect()]
    assert set(order) == {1, 2, 5, 6, 7}
    assert M.mix(empty, ["doc_id"], settings=s).count() == 0 and M.mixed_order(empty, settings=s).count() == 0
    with pytest.raises(ValueError):
        M.mix(awkward, ["doc_id"], settings=M.Settings(weights={"a": -1.0}))


def test_emitted_bytes_stay_within_a_block_and_a_text(spark):
    """Whole texts of up to 40 blocks: after every slot, while both streams last, each one's bytes are within a block and its longest text of its share."""
    import random

    rng = random.Random(6)
    texts = ["x" * (rng.randint(1, 200) if rng.random() < 0.95 else rng.randint(2_000, 20_000)) for _ in range(3_000)]
    df = spark.createDataFrame([(i, t, f"s{i % 3 % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    s = M.Settings(weights={"s0": 0.6, "s1": 0.4}, rest=0.0, block_bytes=512)
    rows = M.mix(df, ["doc_id", "source"], settings=s).where("phase = 0").collect()
    at = defaultdict(Counter)
    for r in rows:
        at[r["slot"]][r["source"]] += len(texts[r["doc_id"]])
    longest = {x: max(len(texts[r["doc_id"]]) for r in rows if r["source"] == x) for x in ("s0", "s1")}
    seen = Counter()
    for t in range(max(at) + 1):
        seen.update(at[t])
        for x, w in s.weights.items():
            assert abs(seen[x] - w * (t + 1) * s.block_bytes) < s.block_bytes + longest[x]


def test_rows_that_repeat_an_id_and_a_text_are_spread(spark):
    """A third of the rows are one row: each has its place, and their buckets hold no more rows than others."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CASE WHEN id % 3 > 0 THEN concat('text ', id) ELSE 'same' END AS text", "'a' AS source")
    rows = M.mix(df, ["doc_id", "text"], settings=M.Settings(block_bytes=256)).toPandas()
    assert len(rows) == 30_000 and rows["hash"].nunique() == 30_000
    rows = rows.sort_values("start")
    sizes = rows["text"].str.len().to_numpy()
    assert (rows["start"].to_numpy()[1:] == sizes.cumsum()[:-1]).all()
    same = rows[rows["doc_id"].isna()].groupby(rows["start"] // 16_384).size()
    assert same.iloc[:-1].max() < 2 * same.iloc[:-1].mean()


def test_texts_without_bytes_have_one_order(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "", "a") for i in range(200)], "doc_id long, text string, source string")
    orders = {tuple(r["doc_id"] for r in M.mixed_order(df.repartition(n)).collect()) for n in (1, 3, 7)}
    assert len(orders) == 1


def test_clashing_columns(awkward):
    out = M.mix(awkward.selectExpr("*", "1 AS bucket", "2 AS hash", "3 AS kept", "4 AS start"), ["stream", "h", "slot", "block", "bucket", "hash", "kept", "start", "text"])
    assert out.columns == ["stream", "h", "slot", "block", "bucket", "hash", "kept", "start", "text", "_stream", "_start", "_hash", "_block", "phase", "release", "deadline", "_slot"]
    assert {r["stream"] for r in out.collect()} == {"y"} and {r["_stream"] for r in out.collect()} == {"*"}


def test_the_layout_keeps_the_rows_and_nearly_the_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = M.Settings(weights={"src0": 0.5, "src1": 0.2}, rest=0.3, block_bytes=512)
    laid = M.mixed_layout(docs, settings=s, partition_rows=40)
    assert laid.columns == docs.columns and sorted(map(str, laid.collect())) == sorted(map(str, docs.collect()))
    slot = {r["doc_id"]: (r["slot"], r["start"]) for r in M.mix(docs, ["doc_id"], settings=s).collect()}
    one = [slot[r["doc_id"]] for r in M.mixed_layout(docs, settings=s).collect()]
    assert one == sorted(one)
    plan = laid._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan  # rows go straight to their range
    # partitions hold ranges that follow each other, each in order
    parts = laid.withColumn("part", F.spark_partition_id()).select("part", "doc_id").collect()
    held = {}
    for part, i in parts:
        held.setdefault(part, []).append(slot[i])
    assert len(held) >= 3 and all(v == sorted(v) for v in held.values())
    firsts = [min(held[p]) for p in sorted(held)]
    assert firsts == sorted(firsts)
