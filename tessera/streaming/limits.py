"""Streams: the sliding-log limiter and co-retrieval reinforcement."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.ops import admit
from tessera.sources.scratch import new_path


BUCKETS = 4096  # of keys, by hash: a call of Python and a row of state are for a bucket


def rate_limit_stream(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """A stream of (key, id, at) with allowed; at: seconds since 1970. A key's state is its log of accepted times, at most `limit` numbers, and leaves once the stream's time has passed the last of them by the window.

    Keys share calls and rows of state by BUCKETS, as a call a key costs more than the key's work. Batches must come in time order, and a row later than a window behind the stream's time is dropped,
    as is one without a time or from before 1970; of one batch a task sorts a bucket's rows, which bounds how large a batch may be: set maxFilesPerTrigger where a key may be hot.
    """
    span = int(window * 1e6)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log, passed = {}, state.getCurrentWatermarkMs()
        if state.exists:
            keys, sizes, times = state.get
            ends = list(accumulate(sizes))
            log = {k: deque(times[end - n : end]) for k, n, end in zip(keys, sizes, ends, strict=True)}
        if not state.hasTimedOut:
            held = pd.concat(list(frames), ignore_index=True).sort_values(["key", "at", "id"])
            for lo in range(0, len(held), 10_000):
                part = held.iloc[lo : lo + 10_000]
                allowed = [admit(log.setdefault(k, deque()), at, limit, window)[0] for k, at in zip(part["key"].tolist(), part["at"].tolist(), strict=True)]
                yield pd.DataFrame({"key": part["key"], "id": part["id"], "allowed": allowed})
        until = {k: int((hits[-1] + window) * 1000) + 1 for k, hits in log.items() if hits}
        log = {k: log[k] for k, end in until.items() if end > passed}
        if log:
            state.update((list(log), [len(hits) for hits in log.values()], [t for hits in log.values() for t in hits]))
            state.setTimeoutTimestamp(max(min(until[k] for k in log), passed + 1))
        elif state.exists:
            state.remove()

    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    timed = requests.select(bucket, "key", "id", "at", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts")).where("at IS NOT NULL").withWatermark("ts", f"{span} microseconds")
    return timed.groupBy("bucket").applyInPandasWithState(run, "key string, id long, allowed boolean", "keys array<string>, sizes array<int>, hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def expired_leases(beats: DataFrame, lease: float, late: float = 0.0) -> DataFrame:
    """Of a stream of heartbeats (job, ts) the leases that ran out: (job, since, until, beats).

    A heartbeat renews its job's lease for `lease` seconds, and one that comes at its very end or later begins another. A lease is given out when the stream's
    time has passed its end by `late` seconds, for which late heartbeats are waited for; its state goes with it. Those still held are not given.
    """
    timed = beats.where("job IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{int(late * 1e6)} microseconds")
    held = timed.groupBy(F.session_window("ts", f"{int(lease * 1e6)} microseconds").alias("w"), "job").agg(F.count("*").alias("beats"))
    return held.select("job", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "beats")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there, into a table of the shared folder; its rows."""
    spark = stream.sparkSession
    root = new_path(spark, "streams")
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def reinforce(turns: DataFrame) -> DataFrame:
    """Pairs of chunks of a stream of (turn, chunks, ts), with weights that each turn adds one to. Each batch is written under its number, so a repeated batch replaces itself."""
    spark = turns.sparkSession
    root = new_path(spark, "streams")

    def add(batch: DataFrame, number: int) -> None:
        each = batch.select("turn", F.explode(F.array_distinct("chunks")).alias("a"), "chunks", "ts")
        pairs = each.select("turn", "a", F.explode(F.array_distinct("chunks")).alias("b"), "ts").where("a < b")
        pairs.groupBy("a", "b").agg(F.count("*").alias("turns"), F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = turns.writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(f"{root}/out")
    return parts.groupBy("a", "b").agg(F.sum("turns").alias("turns"), F.max("last").alias("last"))


def place_stream(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, distance): each newly embedded document of a stream (id, embedding) at its nearest centre (cluster, embedding)."""
    from tessera.operators.graph import place

    return place(vectors, centres)
