import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dedup import _components

from tessera.llm import _tokens, language_id


def _stages(spark, sf_dir):
    """Each stage's input and output rows, stored in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return out


def _bag(df):
    return Counter(map(str, df.collect()))


def test_stages_against_brute_force(spark, sf):
    stages = _stages(spark, sf)
    assert [n for n, *_ in stages] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and not _bag(after) - _bag(before)
    _, before, after = stages[0]
    tagger = language_id.train(before.select("text", "lang"), language_id.Settings())
    judged = language_id.predict(before, tagger, ["doc_id"]).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_LANGUAGE_SCORE}")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in judged.collect()} and after.count() > 0.9 * before.where("text rlike '[a-zA-Z]'").count()
    _, before, after = stages[1]
    groups = defaultdict(list)
    for r in before.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(map(min, groups.values()))
    _, before, after = stages[2]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, _, kept in _components(before.collect(), 5) if kept)
    _, before, after = stages[3]
    assert _bag(before) == _bag(after)
    _, before, after = stages[4]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sizes, held = Counter(), defaultdict(list)
    for r in after.collect():
        sizes[r["doc_id"]] += r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sizes == {i: len(_tokens.ids(_tokens.default_path(), t)) + 1 for i, t in texts.items()}
    for rows in held.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(sizes.values()) // 2048) + 1
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, after.select("doc_id", "piece", "ids_crc32").collect()))


def test_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    for name, df in (("awkward", awkward), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = {r["doc_id"] for r in rows}
        if name == "empty":
            assert not rows
        else:  # no text without a letter, and one of each group; rows with a null id stay
            assert ids <= {1, 6, 9, 10, 11, None} and {1, 6, None} <= ids
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, "").columns == awkward.columns, stage_name
