import json

from pyspark.sql import functions as F

from tessera.functions import variants as V
from tessera.operators import evidence as E

TEXTS = ['{"k": 87, "a": {"b": [1, 2, "x"]}}', "[1,2]", "broken", None, "{}", '"t"', '{"a":{"b":null}}', '{"a":[{"b":1}]}']


def _set(value, path, new, create):
    """jsonb_set's rule, on plain values."""
    key, rest = path[0], path[1:]
    if isinstance(key, str) and isinstance(value, dict):
        if key in value or (create and not rest):
            return {**value, key: _set(value.get(key), rest, new, create) if rest else new}
    if isinstance(key, int) and isinstance(value, list):
        place = key if key >= 0 else len(value) + key
        if 0 <= place < len(value):
            return [(_set(x, rest, new, create) if rest else new) if i == place else x for i, x in enumerate(value)]
        if create and not rest:
            return [new, *value] if place < 0 else [*value, new]
    return value


def test_paths_set_anew_as_on_plain_values(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("v", V.parsed(F.col("t"))).orderBy("i")
    for path in (["z"], ["k"], ["a", "b"], ["a", "c"], ["q", "b"], ["a", "b", 1], ["a", "b", -1], ["a", "b", -9], ["a", 0, "b"], [0], [7], [-1], [-3]):
        for create in (True, False):
            got = [r[0] for r in rows.select(F.to_json(V.with_path(F.col("v"), path, V.from_value(F.array(F.col("i"))), create))).collect()]
            for i, (text, found) in enumerate(zip(TEXTS, got, strict=True)):
                if text in (None, "broken"):
                    assert found is None
                else:
                    assert json.loads(found) == _set(json.loads(text), path, [i], create), (text, path, create)


def test_lengths_elements_and_kinds(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("v", V.parsed(F.col("t"))).orderBy("i")
    b = V.at(F.col("v"), "$.a.b")
    got = rows.select(V.length(b).alias("n"), V.elements(b, "int").alias("e"), V.at(F.col("v"), "$.k", "int").alias("k"), V.length(F.col("v")).alias("own")).collect()
    assert [r["n"] for r in got] == [3] + [None] * 7 and got[0]["e"] == [1, 2, None] and got[1]["e"] is None
    assert [r["k"] for r in got] == [87] + [None] * 7 and [r["own"] for r in got] == [None, 2] + [None] * 6


def test_checkpoints_after_enrichment(spark):
    held = [(1, '{"enriched_surfaces":[2],"complex_surfaces":[1,2,3],"x":"é"}'), (2, "{}"), (3, '{"complex_surfaces":[5]}'), (4, "broken"), (5, "[1]"), (6, '{"complex_surfaces":[1,2]}'), (7, None)]
    done = [(1, 1), (1, 1), (1, 2), (2, 9), (3, 5), (4, 1), (5, 1), (7, 1), (6, None), (99, 1), (None, 1)]
    rows = E.checkpointed(spark.createDataFrame(held, "generation int, checkpoint string"), spark.createDataFrame(done, "generation int, surface int")).collect()
    got = {r["generation"]: (r["checkpoint"], round(r["completeness"], 6), r["state"]) for r in rows}
    assert got[1] == ('{"complex_surfaces":[1,2,3],"enriched_surfaces":[1,2],"x":"é"}', 0.666667, "partial")
    assert got[2] == ('{"enriched_surfaces":[9]}', 1.0, "active") and got[3] == ('{"complex_surfaces":[5],"enriched_surfaces":[5]}', 1.0, "active")
    assert got[4][0] == "broken" and got[5][0] == "[1]" and got[7][0] is None and sorted(got) == [1, 2, 3, 4, 5, 7]
