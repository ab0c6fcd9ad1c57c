"""State that leaves, and leases that run out, in streams of several batches."""

import random
import tempfile

from pyspark.sql import functions as F

from tessera.streaming import limits


def _batches(spark, rows, schema):
    """A stream of files, one a batch, in order."""
    root = tempfile.mkdtemp(prefix="spark-")
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in/n={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{root}/in/n=*"), root


def _run(stream, root):
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress, stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out").collect()


def test_limiter_keeps_no_key_beyond_its_window(spark):
    rows = [[("a", 1, 100.0), ("a", 2, 101.0), ("a", 3, 102.0), ("b", 4, 102.0)], [("a", 5, 109.0), ("a", 6, 111.5)], [("c", 7, 1000.0), ("x", 8, None)]]
    stream, root = _batches(spark, rows, "key string, id long, at double")
    progress, got = _run(limits.rate_limit_stream(stream, 2, 10.0), root)
    assert {r["id"]: r["allowed"] for r in got} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert kept[-1] == 1  # only c is within its window


def test_leases_that_heartbeats_renew_and_that_run_out(spark):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [[("a", t(0)), ("a", t(8)), ("b", t(0)), (None, t(1)), ("z", None)], [("a", t(15)), ("b", t(9))], [("b", t(100)), ("a", t(111))]]
    stream, root = _batches(spark, rows, "job string, ts string")
    beats = stream.select("job", F.col("ts").cast("timestamp").alias("ts"))
    _, got = _run(limits.expired_leases(beats, 10.0), root)
    found = {(r["job"], str(r["since"])[-5:], str(r["until"])[-5:], r["beats"]) for r in got}
    assert found == {("a", "00:00", "00:25", 3), ("b", "00:00", "00:19", 2), ("b", "01:40", "01:50", 1)}  # a's last lease is still held


def test_many_keys_share_calls_and_rows_of_state(spark, monkeypatch):
    monkeypatch.setattr(limits, "BUCKETS", 3)
    rng = random.Random(2)
    keys = [*(f"k{i}" for i in range(40)), None]
    rows = [[(rng.choice(keys), n * 1000 + i, 100 + n * 30.0 + i / 10) for i in range(300)] for n in range(3)]
    stream, root = _batches(spark, rows, "key string, id long, at double")
    progress, got = _run(limits.rate_limit_stream(stream, 2, 20.0), root)
    log, want = {}, {}
    for k, i, at in (r for part in rows for r in part):
        hits = [h for h in log.get(k, []) if at - h < 20.0]
        want[i] = (k, len(hits) < 2)
        log[k] = [*hits, at] if len(hits) < 2 else hits
    assert {r["id"]: (r["key"], r["allowed"]) for r in got} == want and len(got) == 900
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 3
