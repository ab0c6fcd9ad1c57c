"""The trie of conversations' common prefixes, built level by level.

A node of depth d is a distinct sequence of d first turns; the conversations that begin with it are its members, and the least of
their ids names it. Turns go by a SHA-256 of role and text; a level's turns lie together.

1. Down: at each depth the live conversations are grouped by (parent node, next turn); the least conv_id of a group names the new
   node, and the members that go on are live at the next depth. A node whose members are all alike to their ends (alone, or copies,
   told by 128 bits over all their turns) branches no more: it is closed, its members leave, and the chain below it comes from one
   of them in a single join. So there are as many levels as turns that different conversations share, not as the longest one has.
2. Up: level by level, children are joined to their parents, which sum up leaves and saved bytes.

Groups are aggregated before they are shuffled; the join that tells members their node is with one row a group. What ends at a node is
hashed over numerically sorted ids: ranges of (node, id) make chunks of text, and one task streams a node's chunks through SHA-256,
which can be computed in order alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered
from tessera.llm._io import small, stash, tidy
from tessera.sources.scratch import new_path

NOTHING = hashlib.sha256(b"").hexdigest()
BLOCK_TURNS = 1024
ENDS = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])


def numbered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, n_bytes, pos): every turn's place (from 1), a SHA-256 of role and text, and the text's UTF-8 bytes.

    Turns stand by their number, null first, then by role and text; repeated turns each count. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key")
    kept = [F.col("conv_id"), key, F.octet_length("text").cast("long").alias("n_bytes")]
    return numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "pos", kept)


def branched(turns: DataFrame, head: Column, length: Column, most: int) -> DataFrame:
    """turns (conv_id, key, n_bytes, pos), stored, with each conversation's first `length` ones (at most `most`) replaced by those of conversation `head`: all that it has, if fewer, and none if there is no such one. Both are columns of conv_id."""
    sizes = stash(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    asked = sizes.select("conv_id", head.alias("head"), length.cast("long").alias("h"))
    held = sizes.select(F.col("conv_id").alias("head"), "n")
    asked = asked.join(small(held), "head", "left").select("conv_id", "head", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("kept"))
    asked = small(stash(asked, "heads"))
    own = turns.join(asked.select("conv_id", "h", "kept"), "conv_id").where("pos > h").select("conv_id", "key", "n_bytes", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"))
    theirs = asked.select(F.col("conv_id").alias("of"), F.col("head").alias("conv_id"), "h")
    first = turns.where(F.col("pos") <= most).join(theirs, "conv_id").where("pos <= h").select(F.col("of").alias("conv_id"), "key", "n_bytes", "pos")
    return own.unionByName(first)


def _fitted(live: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Groups of live conversations, each a node."""
    wide = lambda c: [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    rows = live.groupBy(*keys).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.max("spent").alias("spent"), F.max("total").alias("total"), *wide("n_turns"), *wide("x"), *wide("y")
    )
    apart = (F.col("lo_n_turns") != F.col("hi_n_turns")) | (F.col("lo_x") != F.col("hi_x")) | (F.col("lo_y") != F.col("hi_y"))
    return rows.where("n > 0").select(F.lit(depth).cast("long").alias("depth"), "node", *keys, "n", "n_bytes", "spent", "total", F.col("hi_n_turns").alias("n_turns"), apart.alias("open"))


def _kept(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """df as a stored table, whose path joins paths."""
    paths.append(new_path(df.sparkSession, name))
    df.write.parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(paths[-1])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            depth, node, ids = (c.to_numpy() for c in b.columns)
            start = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, start[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(depth[start]), pa.array(node[start]), pa.array(ids[start]), pa.array(texts, pa.string())], schema=ENDS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], schema=DIGESTS)

    for b in batches:
        for depth, node, text in zip(b.column("depth").to_pylist(), b.column("node").to_pylist(), b.column("ids"), strict=True):
            if (depth, node) == now:
                sha.update(b",")
            else:
                if now is not None:
                    yield row()
                now, sha = (depth, node), hashlib.sha256()
            sha.update(text.as_buffer())
    if now is not None:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of a stored table (depth, node, conv_id): the lower-case SHA-256 of each node's ids, sorted as numbers and joined by commas."""
    along = ["depth", "node", "conv_id"]
    parts = ends.select(*along).repartitionByRange(*along).sortWithinPartitions(*along).mapInArrow(tidy(_chunks), "depth long, node long, first long, ids string")
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(tidy(_hashed), "depth long, node long, ends_sha256 string")


def _chains(laid: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes beneath closed ones, from the turns of the conversation that names them."""
    reps = nodes.where("NOT open AND n_turns > depth").select(F.col("node").alias("conv_id"), "depth", "n", "n_turns")
    rows = laid.join(reps, "conv_id").where("pos > depth").select("conv_id", F.col("pos").alias("depth"), "n", "n_turns", "n_bytes")
    own = ["conv_id", "depth", "n", "n_turns"]
    # of copies, the bytes from each turn to the end: within blocks of turns, then over blocks
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK_TURNS))
    copies = rows.where("n > 1")
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = copies.groupBy("conv_id", "block").agg(F.sum("n_bytes").alias("held")).select("conv_id", "block", F.coalesce(F.sum("held").over(later), F.lit(0)).alias("after"))
    within = F.sum("n_bytes").over(Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()))
    copies = copies.withColumn("within", within).join(blocks, ["conv_id", "block"]).select(*own, ((F.col("n") - 1) * (F.col("within") + F.col("after"))).alias("saved_tokens"))
    rows = rows.where("n = 1").select(*own, F.lit(0).cast("long").alias("saved_tokens")).unionByName(copies)
    return rows.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", (F.col("depth") == F.col("n_turns")).alias("ended"),
    )


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Of conversations (conv_id; distinct) and their turns (conv_id, pos from 1 without gaps, key, n_bytes), a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the least member's, parent_conv_id the parent node's (null for the root, of depth 0, whose members are all
    conversations, turnless ones too). n_leaves: childless nodes of the subtree; saved_tokens: the sum over the subtree of (n_convs - 1) x
    n_bytes of the node's last turn; ends_sha256: ends_digests() of the members that end at the node. Without a conversation there is no
    node.
    """
    spark = turns.sparkSession
    laid = stash(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "levels")
    told = laid.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("n_bytes").alias("total"), F.bit_xor(F.xxhash64("pos", "key")).alias("x"), F.bit_xor(F.xxhash64("key", "pos")).alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    live = stash(ids.select("conv_id").join(told, "conv_id", "left").select("conv_id", *map(zero, ("n_turns", "total", "x", "y")), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("spent")), "live")

    levels, members, depth = [], [], 0
    found = _kept(_fitted(live, [], 0).withColumn("parent", F.lit(None).cast("long")), "nodes", levels)
    root = found.first()
    own = ["conv_id", "n_turns", "total", "x", "y", "spent"]
    told_node = lambda rows: rows.select(*own, "node", "open", "n", F.lit(depth).cast("long").alias("depth"))
    if root is not None:
        live = _kept(told_node(live.withColumns({"node": F.lit(root["node"]), "open": F.lit(root["open"]), "n": F.lit(root["n"])})), "members", members)
    while found.where("open").limit(1).count():
        depth += 1
        on = live.where(f"open AND n_turns >= {depth}").select(*own, F.col("node").alias("parent"))
        step = stash(laid.where(F.col("pos") == depth).select("conv_id", "key", "n_bytes").join(on, "conv_id"), "step")
        found = _kept(_fitted(step, ["parent", "key"], depth), "nodes", levels)
        joined = step.join(small(found.select("parent", "key", "node", "open", "n")), ["parent", "key"])
        live = _kept(told_node(joined.withColumn("spent", F.col("spent") + F.col("n_bytes"))), "members", members)

    up, nodes = None, []
    for d in range(depth, -1, -1):
        rows = spark.read.parquet(levels[d]).select("depth", "node", "parent", "n", "n_bytes", "spent", "total", "n_turns", "open")
        if up is None:
            up = spark.createDataFrame([], "node long, n_children long, n_leaves long, saved long")
        rows = rows.join(up, "node", "left")
        below = {"n_children": (F.col("n_turns") > F.col("depth")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved": (F.col("n") - 1) * (F.col("total") - F.col("spent"))}
        sums = {"n_children": F.col("n_children"), "n_leaves": F.col("n_leaves"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("n_bytes")}
        rows = _kept(rows.withColumns({c: F.when(F.col("open"), sums[c]).otherwise(below[c]) for c in below}), "rolled", nodes)
        up = rows.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    nodes = spark.read.schema(rows.schema).parquet(*nodes)
    at = nodes.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        (~F.col("open") & (F.col("depth") == F.col("n_turns"))).alias("ended"),
    )
    every = at.unionByName(_chains(laid, nodes))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    single = every.where("n_convs = 1").select(*out, F.when(F.col("ended"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"))
    if not members:
        return single
    ends = spark.read.schema(live.schema).parquet(*members).where("n > 1 AND (NOT open OR n_turns = depth)")
    ends = ends.select(F.when(F.col("open"), F.col("depth")).otherwise(F.col("n_turns")).alias("depth"), "node", "conv_id")
    digests = ends_digests(ends).withColumnRenamed("node", "conv_id")
    shared = every.where("n_convs > 1").join(digests, ["conv_id", "depth"], "left").select(*out, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return single.unionByName(shared)
