"""Near duplicates by an inverted join of MinHash signatures' coordinates.

1. Every text becomes its set of distinct word shingles (64-bit fingerprints) and a signature of `coordinates` minima. Texts with
   the same set are one node from here on.
2. A link needs at least `least_matches` equal coordinates. So two linked nodes share one of any
   coordinates - least_matches + 1 coordinates, taken in one order for all: each node is posted only under its rarest
   (coordinate, value) pairs (prefix filter), which keeps frequent passages out of the postings. Rarity comes from a table of
   hashed counters over all signatures, of fixed size; any fixed order is right, a good one is fast.
3. Postings of at most `short` nodes give all their pairs, longer ones each node with their least. Pairs whose sizes rule a
   link out are skipped; of the others the equal coordinates are counted, and those with `least_matches` are candidates.
4. Candidates are confirmed on the full sets: first each node with its least partner, then only those that components of
   confirmed links have not joined yet (what cannot change the result is skipped, as in skip merging).
5. Long postings that still hold several components are compared on the full sets: by bands of set sizes, of which only the same
   and neighbouring ones can hold a link, in blocks of at most about `block` nodes and BLOCK_BYTES a side, and only links that join
   components come out. So no link is lost, and no task holds a whole posting or emits all its pairs. Equal coordinates are not
   counted there, so a link that step 3 would have missed by chance may be found; every link is confirmed in either case.

At a similarity of exactly 0.8 the defaults (48 coordinates, 29 matches) miss a pair with probability 0.0006, above 0.85 with
0.00001; members of a group have several ways to be found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import _words
from tessera.llm._components import components
from tessera.llm._io import fresh, small, stash, tidy

COUNTER_BITS, COUNTER_BLOCK = 18, 1 << 12
BLOCK_BYTES = 4 << 20  # of the sets on one side of a comparison


@dataclass(frozen=True)
class Settings:
    shingle_words: int = 5
    percent: int = 80
    coordinates: int = 48
    least_matches: int = 29
    short: int = 32
    block: int = 1024
    seed: int = 5


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: _words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all documents' distinct shingles, sorted within each document, and where each document's begin (and the last end). Fewer than k words: one shingle of them all."""
    h, odd, n = _words.fingerprints(w), _odd(99, k + 1), len(w.start)
    last = np.repeat(w.first[1:], w.counts)  # the end of each word's document
    sums, at = np.zeros(n, np.uint64), np.arange(n)
    for j in range(k):
        inside = at + j < last
        sums[inside] += h[(at + j)[inside]] * odd[j]
    short = np.repeat(w.counts, w.counts) < k
    first = at == np.repeat(w.first[:-1], w.counts)
    sums[short] += (last - at)[short].astype(np.uint64) * odd[k]
    real = (at + k <= last) | (short & first)
    value, doc = _words.mix(sums[real]), w.doc[real]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(w.first)))


def _signatures(s: Settings, schema: pa.Schema):
    mul, add = _odd(s.seed, s.coordinates), _odd(s.seed + 1, s.coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.batches(b.column(2)):
                value, first = shingle_sets(w, s.shingle_words)
                size = np.diff(first)
                full = np.flatnonzero(size)
                node, sig = np.zeros(j - i, np.int64), np.zeros((j - i, s.coordinates), "<u4")
                if len(full):
                    start = first[:-1][full]
                    for c in range(s.coordinates):
                        sig[full, c] = np.minimum.reduceat(value * mul[c] + add[c], start) >> np.uint64(32)
                    node[full] = _words.mix(np.add.reduceat(_words.mix(value ^ np.uint64(0x9E3779B97F4A7C15)), start) + size[full].astype(np.uint64)).view(np.int64)
                none = size == 0
                raw = sig.tobytes()
                step = 4 * s.coordinates
                held = [None if x else raw[k * step : (k + 1) * step] for k, x in enumerate(none)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(node, mask=none), pa.array(size.astype(np.int64)), pa.array(held, pa.binary())], schema=schema)

    return run


def signatures(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, sig) of every whole text; node (a fingerprint of the set) and sig are null where there is no word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text_key", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary())])
    return rows.mapInArrow(tidy(_signatures(s, schema)), f"doc_id {kind.simpleString()}, text_key long, node long, n_shingles long, sig binary")


# --- postings -----------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, width)


def _keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair."""
    return _words.mix((np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32)) | sig)


def _tally(width: int):
    """A task's counters, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            count += np.bincount((_keys(_matrix(b.column(0), width)) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64).ravel(), minlength=len(count))
        blocks = count.reshape(-1, COUNTER_BLOCK)
        for i in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "n": pa.array([blocks[i].astype("<i8").tobytes()], pa.binary())})

    return run


def _tally_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, n in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(n, "<i8")
    for i, n in sums.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "n": pa.array([n.tobytes()], pa.binary())})


def _rarity(nodes: DataFrame, s: Settings) -> np.ndarray:
    """Counters of hashed coordinate-value pairs over all nodes: 2**COUNTER_BITS numbers, whatever the input."""
    blocks = nodes.select("sig").mapInArrow(_tally(s.coordinates), "block int, n binary").repartition("block").mapInArrow(_tally_up, "block int, n binary")
    out = np.zeros((1 << COUNTER_BITS) // COUNTER_BLOCK * COUNTER_BLOCK, np.int64).reshape(-1, COUNTER_BLOCK)
    for i, n in blocks.collect():
        out[i] = np.frombuffer(n, "<i8")
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _post(rarity: np.ndarray, s: Settings):
    prefix = s.coordinates - s.least_matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                keys = _keys(_matrix(c.column("sig"), s.coordinates))
                seen = rarity[(keys >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.lexsort((keys, seen), axis=1)[:, :prefix]
                chosen = np.take_along_axis(keys, order, 1).view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array(chosen.ravel()), "node": c.column("node").take(pa.array(np.repeat(np.arange(len(c)), prefix)))})

    return run


def _match(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column("sig_a"), s.coordinates) == _matrix(b.column("sig_b"), s.coordinates)).sum(1)
                yield b.select(["a", "b"]).filter(pa.array(same >= s.least_matches))

    return run


# --- confirming ---------------------------------------------------------------------------------------------------------


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.batches(b.column("text")):
                value, first = shingle_sets(w, s.shingle_words)
                held = [value[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node")[i:j], pa.array(held, pa.binary())], names=["node", "members"])

    return run


def member_sets(df: DataFrame, text_col: str, nodes: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(node, members) of the wanted nodes: their sorted shingle fingerprints, from the text of one of their documents."""
    keys = stash(nodes.join(wanted, "node", "left_semi").select("node", "text_key"), "wanted")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(small(keys), "text_key").select("node", "text")
    return stash(rows.mapInArrow(tidy(_sets(s)), "node long, members binary").dropDuplicates(["node"]), "sets")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("members_a").to_pylist(), b.column("members_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"members_{x}"))
    return stash(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "members_a", "members_b").mapInArrow(tidy(_confirm(s.percent)), "a long, b long"), "links")


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of the block's two parts: links that join components (the first found; what they imply is skipped)."""
        rows = rows.drop_duplicates(["node", "side"])
        within = not rows["up"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]
        if not within and rows["side"].nunique() < 2:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
        ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        first = np.cumsum(size) - size
        node, part = rows["node"].to_numpy(), rows["root"].to_numpy().copy()
        side, mark, out = rows["side"].to_numpy(), np.zeros(len(ids), bool), []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        for i in left:
            apart = right[part[right] != part[i]]
            if not len(apart):
                continue
            own = flat[first[i] : first[i] + size[i]]
            mark[own] = True
            same = np.add.reduceat(mark[flat].astype(np.int32), first)[apart]
            mark[own] = False
            for j in apart[100 * same >= percent * (size[i] + size[apart] - same)]:
                if part[i] != part[j]:
                    out.append((node[i], node[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _long_links(postings: DataFrame, nodes: DataFrame, roots: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Step 5: links between components within long postings (key, node)."""
    rows = postings.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = stash(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    # sizes of linked sets differ by 100 / percent at most, which a band is a little wider than
    band = F.floor(F.log("n_shingles") / F.log(F.lit(101 / s.percent))).cast("int")
    rows = stash(rows.join(small(mixed), "key", "left_semi").join(nodes.select("node", "n_shingles"), "node").select("key", "node", "root", band.alias("band"), "n_shingles"), "bands")
    bands = rows.groupBy("key", "band").agg(F.ceil(F.greatest(F.count("*") / s.block, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("chunks"))
    bands = stash(bands, "chunks")
    beside = lambda step, name: bands.select("key", (F.col("band") - step).alias("band"), F.col("chunks").alias(name))
    bands = stash(bands.join(beside(1, "above"), ["key", "band"], "left").join(beside(-1, "below"), ["key", "band"], "left"), "chunks")
    rows = rows.join(small(bands), ["key", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    own, all_of = F.col("chunk"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda band, up, i, j, side: F.struct(band.alias("band"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    # blocks (i, j), i <= j, of a band: a node of chunk c is in row and column c; blocks of a band and the next one up: in rows of the lower and columns of the upper
    none = F.array().cast("array<struct<band: int, up: boolean, i: int, j: int, side: int>>")
    cells = F.concat(
        F.transform(all_of("chunks"), lambda o: cell(F.col("band"), False, F.least(own, o), F.greatest(own, o), own > o)),
        F.when(F.col("above").isNull(), none).otherwise(F.transform(all_of("above"), lambda o: cell(F.col("band"), True, own, o, F.lit(0)))),
        F.when(F.col("below").isNull(), none).otherwise(F.transform(all_of("below"), lambda o: cell(F.col("band") - 1, True, o, own, F.lit(1)))),
    )
    rows = rows.select("key", "node", "root", F.explode(cells).alias("cell")).select("key", "node", "root", "cell.*")
    return rows.join(sets, "node").groupBy("key", "band", "up", "i", "j").applyInPandas(_compare(s.percent), "a long, b long")


def links(df: DataFrame, text_col: str, nodes: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) of nodes (node, text_key, n_shingles, sig) that join all that the similarity joins; links that others imply may be left out."""
    held = stash(nodes.select("node", "sig").mapInArrow(tidy(_post(_rarity(nodes, s), s)), "key long, node long"), "postings")
    lists = held.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    shared = stash(held.join(lists, "key"), "shared")
    short = shared.where(F.col("n") <= s.short)
    pairs = short.select("key", F.col("node").alias("a")).join(short.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    stars = shared.where((F.col("n") > s.short) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(stars).distinct()
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))
    candidates = stash(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(_match(s)), "a long, b long"), "candidates")
    long = shared.where(F.col("n") > s.short)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).union(long.select("node")).distinct()
    sets = member_sets(df, text_col, nodes, wanted, s)

    star = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = confirmed(star, sets, s)
    roots = stash(components(first), "roots")
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    open_ = candidates.join(star, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    second = confirmed(open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")), sets, s)
    return first.union(second).union(stash(_long_links(long, nodes, roots, sets, s), "long"))


def _grouped(df: DataFrame, id_col: str, text_col: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, text_key, node, n_shingles), and (node, component_id, keep_key) of the row that stays of each node's component: the one with the least id (nulls last), then text_key."""
    rows = stash(signatures(df, id_col, text_col, s), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = rows.where("node is not null").groupBy("node").agg(first, F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    nodes = stash(nodes, "nodes")
    roots = stash(components(links(df, text_col, nodes, s)), "roots")
    least = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("of_all"))
    joined = roots.join(least, "root").select("node", "of_all")
    kept = nodes.select("node", "first").join(joined, "node", "left").select("node", F.coalesce("of_all", "first").alias("first"))
    return rows, stash(kept.select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("keep_key")), "ids")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of df: doc_id, n_shingles, component_id (the least id reachable over links), kept (doc_id = component_id).

    Null and blank texts have no shingle, no link, and are kept as their own component. Null ids come after all others: a
    component of null ids alone has a null component_id, and its rows count as kept. Rows that repeat an id within a component
    share its fate. An empty table gives an empty result.
    """
    rows, ids = _grouped(df, id_col, text_col, settings)
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = rows.where("node is not null").select("doc_id", "n_shingles", "node").join(ids, "node")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """df without near copies: all columns; of each component the document with the least id stays, null ids last.

    A document is an id and a text: of an id's rows with different texts each has the fate of its own component, and if several
    have the least id of one component, one text stays. Rows alike in id and text are one document and stay or go together.
    Null and blank texts stay.
    """
    rows, ids = _grouped(df, id_col, text_col, settings)
    gone, key = fresh(df, "gone"), fresh(df, "key")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keep_key"))
    lost = rows.where("node is not null").select("doc_id", "text_key", "node").join(ids, "node").where(~stays)
    dropped = stash(lost.select(F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct(), "dropped")
    return df.join(small(dropped), F.col(id_col).eqNullSafe(F.col(gone)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key)), "left_anti")
