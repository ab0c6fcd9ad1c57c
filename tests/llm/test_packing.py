import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _tokens
from tessera.llm import packing as P
from tessera.llm.queries import op8_packing


def _best_fit(lengths, capacity):
    """By a plain scan: the number of bins of best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.data())
def test_against_a_plain_scan(capacity, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=80)), np.int64)
    bins, offsets = P.best_fit_decreasing(lengths, capacity)
    held = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
        held[b].append((o, n))
    for rows in held.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in rows) for rows in held.values()) == _best_fit(lengths.tolist(), capacity)


def test_cut():
    assert list(P.cut(5, 10)) == [(0, 5)] and list(P.cut(10, 10)) == [(0, 10)] and list(P.cut(25, 10)) == [(0, 5), (5, 10), (15, 10)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokens.default_path())


def _ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids if text else []


def test_ids_are_those_of_tokenizers(spark, sf, tokenizer):
    rng = random.Random(4)
    pieces = ["a", "Z", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "0", "42", "é", "ß", "漢字", "😀", " ", "​", "́", "\x00", "<|endoftext|>", "!", "...", " ", "ﬁ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(800)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|>" * 3, "<|endoftext", "x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a" * 2_000_000, " \t" * 700_000 + "<|endoftext|>"]
    assert _tokens.ids(_tokens.default_path(), "a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for t in texts:
        assert _tokens.ids(_tokens.default_path(), t).tolist() == _ids(tokenizer, t), t


def test_query_against_brute_force(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_packing(spark, sf).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    total = 0
    for i, pieces in docs.items():
        ids = np.array([*_ids(tokenizer, texts[i]), 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > 2048)
        total += at
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(sequences) == len(_best_fit([r["length"] for r in rows], 2048)) and len(sequences) <= -(-total // 2048) + 1


def test_very_long_white_space_and_special_strings(spark, tokenizer):
    from tessera.llm import mixing, token_counts

    texts = [" " * 2_000_000, "word" + "\n" * 2_000_000 + "word", "a" * 2_000_000, "a <|endoftext|> b"]
    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(4)
    n = {i: len(_ids(tokenizer, t)) + 1 for i, t in enumerate(texts)}
    for rows in (P.pack_documents(df), P.pack_mixed(df, mixing.Settings())):
        assert {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()} == n
    assert sorted(r["length"] for r in token_counts.length_histogram(df).collect() for _ in range(r["n_docs"])) == sorted(x - 1 for x in n.values())


def test_one_partition_makes_as_many_shards_as_several(spark):
    pieces = spark.range(200_000).selectExpr("id AS doc_id", "cast(1 + id % 700 AS long) AS length", "'x' AS _shard", "id AS sequence_id").coalesce(1)
    out = P.pack(pieces)
    assert sorted(out.columns) == sorted(["doc_id", "length", "_shard", "sequence_id", "offset"])
    rows = out.selectExpr("doc_id", "length", "offset", "sequence_id", "shiftright(sequence_id, 32) AS shard").toPandas()
    assert rows["shard"].nunique() == 4 and rows["shard"].value_counts().max() <= 3 * 65_536 and rows["doc_id"].nunique() == len(rows) == 200_000
    size = rows.groupby("sequence_id")["length"].sum()
    assert size.max() <= 2048 and len(size) <= -(-rows["length"].sum() // 2048) + 8


def test_shards_and_awkward_rows(awkward, empty):
    out = P.pack_documents(awkward.repartition(5), with_ids=True, shard_pieces=3)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in awkward.collect()}
    held = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        assert sum(n for _, n in pieces) <= 2048 and [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert P.pack_documents(empty).count() == 0


def _planted(spark):
    rng = random.Random(8)
    text = lambda low, high: " ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(low, high)))
    rows = [(i, text(20, 60), "src0") for i in range(6900)] + [(10_000 + i, text(300, 500), "src1") for i in range(310)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_prefixes_of_the_pipelines_sequences_keep_the_shares(spark, tmp_path):
    """src0 to src1 as 0.10 to 0.045 within two of the mix's blocks, though src1's texts are ten times as long; both last to the end, or nearly."""
    import corpus_pipeline

    _planted(spark).write.parquet(f"{tmp_path}/docs")
    rows = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    seen, total = defaultdict(int), sum(r["length"] for r in rows)
    block = total * (1 << 16) / sum(len(r["text"]) for r in _planted(spark).collect())
    at, sequences = 0, defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for k in sorted(sequences):
        for r in sequences[k]:
            seen["src1" if r["doc_id"] >= 10_000 else "src0"] += r["length"]
            at += r["length"]
        if at < 0.9 * total:
            assert abs(seen["src0"] - at * 0.10 / 0.145) <= 2 * block
    assert len(rows) == 7210 and len(sequences) <= 1.01 * -(-total // 2048) + 1


def test_shards_along_the_mix(spark):
    """Sequences follow the slots: with windows of 50 pieces no sequence is far from its place."""
    from tessera.llm import mixing

    df, s = _planted(spark).where("doc_id % 5 = 0"), mixing.Settings(weights={"src0": 0.5, "src1": 0.5}, block_bytes=1 << 12)
    slot = {r["doc_id"]: r["slot"] for r in mixing.mix(df, ["doc_id"], settings=s).collect()}
    rows = P.pack_mixed(df, s, shard_pieces=300, window=50).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append(r)
    assert sorted(r["doc_id"] for r in rows) == sorted(slot) and len({k >> 32 for k in held}) > 2
    latest = -1
    for k in sorted(held):
        own = sorted((r["offset"], r["length"]) for r in held[k])
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
        slots = sorted(slot[r["doc_id"]] for r in held[k])
        assert slots[0] >= latest - 20 and slots[-1] - slots[0] <= 20
        latest = max(latest, slots[0])


def test_awkward_rows_along_the_mix(awkward, empty):
    from tessera.llm import mixing

    s = mixing.Settings(weights={"src0": 0.5, "src1": 0.5}, rest=0.1, block_bytes=64)
    rows = P.pack_mixed(awkward, s, shard_pieces=3).collect()
    plain = P.pack_documents(awkward).collect()
    key = lambda r: str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(map(key, rows)) == sorted(map(key, plain))
    assert P.pack_mixed(empty, s).count() == 0


def test_a_slot_with_nearly_all_pieces_is_cut_like_any_other(spark):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "cast(0 AS int) AS piece", "0L AS start", "id % 700 + 1 AS length", "id % 97 AS ids_crc32", "CASE WHEN id < 59901 THEN 7L WHEN id = 59950 THEN NULL ELSE id END AS slot", "0L AS at", "'k' AS _nth")
    out = P.pack_along(rows, 2048, 5000, 1024)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "_nth", "sequence_id", "offset"]
    sizes = {r["shard"]: r["count"] for r in out.selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()}
    assert sizes == dict.fromkeys(range(12), 5000)
    full = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in full) <= 2048 and len(full) <= -(-sum(r[1] for r in full) // 2048) + 12 * 5
    last = out.where("doc_id >= 59901 AND doc_id <> 59950").selectExpr("min(sequence_id >> 32)").first()[0]
    assert last == 11 and out.where("doc_id = 59950").first()["sequence_id"] >> 32 == 0
    assert P.pack_along(rows.limit(0)).count() == 0
