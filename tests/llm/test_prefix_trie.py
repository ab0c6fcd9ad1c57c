import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as P
from tessera.llm._io import stash
from tessera.llm.queries import QUERIES


def _brute(told):
    """told: {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[path]]
        leaves = sum(x for x, _ in below) or 1
        saved = sum(y for _, y in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        sums[path] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(told[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _turns(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in held.items()}


def _rebuilt(told):
    out = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = told.get(5 * int(c / 5), [])[:h] + told[c][h:]
    return out


COLUMNS = "conv_id long, turn long, role string, text string"


def _nodes(df):
    turns = stash(P.numbered_turns(df), "turns")
    return sorted(map(tuple, P.trie(turns, turns.select("conv_id").distinct()).collect()), key=str)


def test_the_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, sf).collect()), key=str) == _brute(_rebuilt(_turns(rows)))


def _odd():
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {min(c, 30) // 10}" if t < 4 else f"own {c % 7} {t}") for c in range(40) for t in range(c % 9)]
    rows += [(None, 1, "user", "nobody's"), (41, None, "user", "no number"), (41, 3, "user", None), (41, 3, None, "same number"), (41, 3, None, "same number"), (42, 0, "", ""), (42, 1, "user", "ü" * 5000)]
    rows += [(-7, 0, "user", "below zero"), (-5, 0, "user", "its head"), (-6, 1, "user", "x")]
    return rows


def test_odd_conversations(spark, tmp_path):
    rows = _odd()
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit(1), "pos": F.lit("p"), "node": F.lit(None).cast("string"), "open": F.lit(True)})
    df.write.parquet(f"file://{tmp_path}/conversations.parquet")
    told = _turns(rows)
    assert sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, f"file://{tmp_path}").collect()), key=str) == _brute(_rebuilt(told))
    assert _nodes(df) == _brute(told)


def test_no_conversation_one_and_turnless_ones(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert _nodes(none) == []
    one = [(5, t, "user", f"t{t}") for t in range(3)]
    assert _nodes(spark.createDataFrame(one, COLUMNS)) == _brute(_turns(one))
    turns = stash(P.numbered_turns(none), "turns")
    ids = spark.createDataFrame([(3,), (10,), (9,)], "conv_id long")
    want = hashlib.sha256(b"3,9,10").hexdigest()
    assert list(map(tuple, P.trie(turns, ids).collect())) == [(3, 0, None, 3, 0, 1, 0, want)]


@pytest.mark.parametrize("partitions", [3, 40])
def test_copies_of_a_long_conversation_and_a_first_turn_of_all(spark, monkeypatch, partitions):
    """Long chains come from closed nodes, whatever their length, and take as many levels as different conversations share."""
    monkeypatch.setattr(P, "BLOCK_TURNS", 64)
    rows = [(c, t, "user", f"the same {t}" * (t % 5)) for c in (11, 3, 700) for t in range(500)]
    rows += [(c, 0, "system", "the first of all") for c in range(1000, 1900)] + [(c, 1, "user", f"{c % 3}") for c in range(1000, 1800)]
    rows += [(2000, t, "user", f"alone {t}") for t in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert _nodes(spark.createDataFrame(rows, COLUMNS).repartition(5)) == _brute(_turns(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_ends_are_hashed_over_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        ends = stash(spark.range(5000).selectExpr("id % 2 AS depth", "0L AS node", "id * 7919 % 5003 - 50 AS conv_id"), "ends")
        for r in P.ends_digests(ends).collect():
            ids = sorted(i * 7919 % 5003 - 50 for i in range(5000) if i % 2 == r["depth"])
            assert r["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
