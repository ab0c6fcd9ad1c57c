"""Mixing sources to target weights by Pfair scheduling.

A stream is a source with a target weight, or all other sources together. Its documents stand in the order of a hash and are cut
into blocks of `block_bytes` bytes. Time runs in slots, one block each. The i-th block of a stream of weight w (i from 0) is
released at slot floor(i / w) and due by slot ceil((i + 1) / w); earliest deadline first meets every deadline on one machine
whose weights add up to one, so after any number of slots each stream is less than one block from its share. Weights are
multiples of 1 / period, so the schedule repeats after `period` slots: one period is simulated on the driver, and every block's
slot follows from it by arithmetic in a join. When a stream ends, the rest share its weight and a new phase begins; each document
stands in the mix once.

Documents are whole: each is emitted at the slot of the block in which it begins. So of a stream's bytes, as emitted after any
number of slots, less than a block plus one document (the one that reaches into later blocks) differs from its blocks' bytes.

Blocks' places come from sums over hash buckets, then within a bucket, so a large source is no single task's. Rows that repeat an
id and a text are spread over the buckets by where they are stored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._io import fresh, small, stash

REST = "*"
MAX_STREAMS = 256  # target weights are a configuration; with the period it bounds the schedule that is broadcast
BUCKET_ROWS = 1024
MOST_BUCKETS = 1 << 19  # of all streams together, so that their table can be broadcast; beyond, buckets have more rows
SUPER = 10  # bits of a bucket's number within a super-bucket


@dataclass(frozen=True)
class Settings:
    """weights: by source; rest: the weight of all sources without one together."""

    weights: dict[str, float] = field(default_factory=dict)
    rest: float = 1.0
    block_bytes: int = 1 << 16
    period: int = 1000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers, at least 1, in proportion to the weights, that add up to period (largest remainders)."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, period - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > period:  # small weights were raised to 1
        out[max(out, key=lambda s: (out[s] - exact[s], out[s]))] -= 1
    return out


def one_period(share: dict[str, int]) -> list[str]:
    """Which stream has each slot: earliest deadline first among released blocks; ties to the larger share, then by name."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // share[s]), -share[s], s, i))
        deadline, _, s, i = heapq.heappop(ready)
        assert deadline > t, "a deadline was missed"
        out.append(s)
        if i + 1 < share[s]:
            heapq.heappush(waiting, ((i + 1) * period // share[s], s, i + 1))
    return out


@dataclass
class Phase:
    base: int  # its first slot
    share: dict[str, int]
    slots: dict[str, list[int]]  # within a period
    first: dict[str, int]  # each stream's first block here
    end: dict[str, int]  # and the one after its last


def phases(blocks: dict[str, int], s: Settings) -> list[Phase]:
    """The schedule of so many blocks a stream."""
    done, base, out = dict.fromkeys(blocks, 0), 0, []
    while left := {x: n - done[x] for x, n in blocks.items() if n > done[x]}:
        weights = {x: s.weights.get(x, s.rest if x == REST else 0.0) for x in left}
        if sum(weights.values()) <= 0:  # only streams of weight 0 are left
            weights = dict.fromkeys(left, 1.0)
        weights = {x: w for x, w in weights.items() if w > 0}
        period = max(s.period, 8 * len(weights))
        share = shares(weights, period)
        slots: dict[str, list[int]] = {x: [] for x in weights}
        for t, x in enumerate(one_period(share)):
            slots[x].append(t)
        end = min((left[x] - 1) // share[x] * period + slots[x][(left[x] - 1) % share[x]] + 1 for x in weights)
        used = {x: end // period * share[x] + sum(t < end % period for t in slots[x]) for x in weights}
        out.append(Phase(base, share, slots, {x: done[x] for x in weights}, {x: done[x] + used[x] for x in weights}))
        base += end
        for x in weights:
            done[x] += used[x]
    return out


@dataclass
class _Plan:
    """rows: the columns kept (as struct `kept`), stream, h, size, bucket; buckets: (stream, bucket, before), at most MOST_BUCKETS rows; blocks: by stream; spans, slots: the schedule."""

    rows: DataFrame
    buckets: DataFrame
    blocks: dict[str, int]
    spans: DataFrame
    slots: DataFrame


def _planned(df: DataFrame, kept: Column, id_col: str, text_col: str, source_col: str, s: Settings) -> _Plan:
    if len(s.weights) >= MAX_STREAMS or min([s.rest, *s.weights.values()]) < 0 or REST in s.weights:
        raise ValueError(f"weights: fewer than {MAX_STREAMS}, none negative, none named {REST}")
    spark = df.sparkSession
    source = F.col(source_col).cast("string")
    stream = F.when(source.isin(*s.weights), source).otherwise(REST) if s.weights else F.lit(REST)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed, size = F.xxhash64(F.col(id_col), F.xxhash64(text)), F.octet_length(text).cast("long")
    rows = df.select(kept.alias("kept"), stream.alias("stream"), hashed.alias("h"), size.alias("size"))
    # rows of one id and text have one hash: where there are such, theirs is drawn anew from their place in a stored copy
    repeated = stash(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    if not repeated.isEmpty():
        rows = rows.withColumn("place", F.monotonically_increasing_id()).join(small(repeated.withColumn("again", F.lit(True))), "h", "left")
        rows = stash(rows.select("kept", "stream", F.when(F.col("again"), F.xxhash64("h", "place")).otherwise(F.col("h")).alias("h"), "size"), "rows")
    bits = min((MOST_BUCKETS // (len(s.weights) + 1)).bit_length() - 1, max(0, (rows.count() // BUCKET_ROWS).bit_length()))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # sums of buckets in two levels, so that no task has all buckets of a stream
    sums = stash(rows.groupBy("stream", "bucket").agg(F.sum("size").alias("size")), "buckets")
    high = F.shiftright("bucket", SUPER)
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("stream", high.alias("high")).agg(F.sum("size").alias("size"))
    supers = supers.select("stream", "high", F.coalesce(F.sum("size").over(before(["stream"], "high")), F.lit(0)).alias("lower"))
    own = F.coalesce(F.sum("size").over(before(["stream", "high"], "bucket")), F.lit(0))
    buckets = sums.withColumn("high", high).withColumn("own", own).join(F.broadcast(supers), ["stream", "high"])  # some hundreds of rows: MOST_BUCKETS / 1024, one a stream at least
    buckets = stash(buckets.select("stream", "bucket", (F.col("own") + F.col("lower")).alias("before")), "before")
    blocks = {x: max(1, -(-n // s.block_bytes)) for x, n in sums.groupBy("stream").agg(F.sum("size")).collect()}  # a row per stream
    plan = phases(blocks, s)
    spans = spark.createDataFrame([(x, k, p.base, p.share[x], sum(p.share.values()), p.first[x], p.end[x]) for k, p in enumerate(plan) for x in p.share], "stream string, phase int, base long, share long, period long, first long, end long")
    slots = spark.createDataFrame([(x, k, i, t) for k, p in enumerate(plan) for x in p.share for i, t in enumerate(p.slots[x])], "stream string, phase int, nth long, at long")
    return _Plan(rows, buckets, blocks, spans, slots)


def _slotted(rows: DataFrame, p: _Plan, s: Settings) -> DataFrame:
    """rows (with stream and start) and their block, phase, release, deadline and slot."""
    count = F.element_at(F.create_map(*[F.lit(v) for x, n in p.blocks.items() for v in (x, n)]), F.col("stream")).cast("long") if p.blocks else F.lit(1).cast("long")
    names = rows.columns
    rows = rows.withColumn("block", F.least(F.floor(F.col("start") / s.block_bytes).cast("long"), count - 1))
    # both tables are bounded by MAX_STREAMS and the period
    rows = rows.join(F.broadcast(p.spans), (rows["stream"] == p.spans["stream"]) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end"))).drop(p.spans["stream"])
    i = F.col("block") - F.col("first")
    rows = rows.withColumns({"nth": F.pmod(i, "share"), "turn": F.expr("(block - first) div share"), "release": F.col("base") + F.expr("((block - first) * period) div share"), "deadline": F.col("base") + F.ceil((i + 1) * F.col("period") / F.col("share"))})
    rows = rows.join(F.broadcast(p.slots), ["stream", "phase", "nth"])
    return rows.select(*names, "block", "phase", "release", "deadline", (F.col("base") + F.col("turn") * F.col("period") + F.col("at")).alias("slot"))


def _started(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with before, the stream's bytes before the bucket) and start; keys: the bucket's."""
    inside = Window.partitionBy(*keys).orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("before"))


OWN = ["stream", "start", "hash", "block", "phase", "release", "deadline", "slot"]


def mix(df: DataFrame, keep: list[str | Column], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The columns `keep` and stream, start (bytes of the stream before it), hash, block, phase, release, deadline, slot.

    Ordered by slot, start, then hash, the rows are the mix. A null source belongs to the rest; a null or empty text has no bytes
    and stands with its neighbour. Repeated rows each have a place; an empty table gives an empty result. Where `keep` has a column
    named like one of the others, that other one's name begins with an underscore.
    """
    p = _planned(df, F.struct(*keep), id_col, text_col, source_col, settings)
    rows = _slotted(_started(p.rows.join(F.broadcast(p.buckets), ["stream", "bucket"]), ["stream", "bucket"]).withColumn("hash", F.col("h")), p, settings)
    kept = df.select(*keep)
    return rows.select(F.col("kept.*"), *[F.col(c).alias(fresh(kept, c) if c in [k.lower() for k in kept.columns] else c) for c in OWN])


def mixed_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """All rows and columns of df, in the order of the mix."""
    rows = mix(df, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")], id_col, text_col, source_col, settings)
    return rows.orderBy("slot", "start", "hash").select("row.*")


def mixed_layout(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: Settings = Settings(), partition_rows: int = 1 << 14) -> DataFrame:  # noqa: B008
    """All rows and columns of df, laid out along the mix in one shuffle: each partition holds one range of its slots, in order, and partitions follow each other.

    Whole buckets are dealt to partitions of about `partition_rows` rows by the slot where they begin, so at a range's end rows may
    stand one bucket (about BUCKET_ROWS rows of their stream) from where mixed_order() has them. Null sources and texts, repeated rows
    and empty tables are as mix() says; no column is added, so none can clash.
    """
    p = _planned(df, F.struct(*[F.col(f"`{c}`") for c in df.columns]), id_col, text_col, source_col, settings)
    starts = _slotted(p.buckets.withColumn("start", F.col("before")), p, settings).select("stream", "bucket", "before", F.col("slot").alias("first_slot"))
    n, last = p.rows.count(), starts.agg(F.max("first_slot")).first()[0] or 0
    parts = max(1, min(1 << 15, n // partition_rows))
    starts = stash(starts.select("stream", "bucket", "before", F.expr(f"first_slot * {parts} div {last + 1}").cast("int").alias("range")), "ranges")
    rows = p.rows.join(F.broadcast(starts), ["stream", "bucket"]).repartitionById(parts, F.col("range"))
    rows = _slotted(_started(rows, ["range", "stream", "bucket"]), p, settings)
    return rows.sortWithinPartitions("range", "slot", "start", "h").select("kept.*")
