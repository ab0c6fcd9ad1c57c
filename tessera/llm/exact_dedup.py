"""Exact duplicates by two-pass Bloom filtering.

Pass 1 reads every digest and marks the cells of a blocked Bloom filter that two rows or more have hit; tasks pre-aggregate
their cells, and each block of the filter is merged on its own. Pass 2 tests each row against the marked cells: a row with an
unmarked cell has a digest of its own and passes straight through; only the others are shuffled, by their SHA-256. A false
positive costs a shuffled row, never a wrong result. The filter is at most `max_filter_bits` (32 MB by default), which bounds
what is broadcast. With that default it has 16 cells a row up to 1.6e7 rows, where 0.2 % of the unrepeated rows pass; 8 % do at 5e7
rows, 36 % at 1e8 and 95 % at 3e8, from where it no longer helps: then exact_groups() shuffles every digest and drop_copies() every
row once. A larger limit moves these points in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import fresh, stash, tidy

BLOCK_BITS = 1 << 15
PROBES = 4


def normalised(text: Column) -> Column:
    """Each run of bytes 0x20, 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows: by block, the cells that one row hits and those that several hit."""
    seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block, cell = keys >> 15, (keys & (BLOCK_BITS - 1)).astype("<u2")
        at = np.flatnonzero(np.diff(block, prepend=-1))
        for lo, hi in zip(at, np.append(at[1:], len(keys)), strict=True):
            c, many = cell[lo:hi], counts[lo:hi] > 1
            yield pa.RecordBatch.from_pydict({"block": pa.array([block[lo]], pa.int64()), "once": pa.array([c[~many].tobytes()], pa.binary()), "again": pa.array([c[many].tobytes()], pa.binary())})

    for b in batches:
        block, h = b.column("block").to_numpy(), b.column("h").to_numpy().view(np.uint64)
        keys = np.sort(np.stack([(block << 15) | ((h >> np.uint64(15 * j)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for j in range(PROBES)], 1), 1)
        keys = keys[np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)]  # a row hits each of its cells once
        new, n = np.unique(keys, return_counts=True)
        seen, at = np.unique(np.concatenate([seen, new]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, n]), len(seen)).astype(np.int64)
        if len(seen) > 4_000_000:
            yield from rows(seen, times)
            seen, times = seen[:0], times[:0]
    if len(seen):
        yield from rows(seen, times)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; one block is held at a time."""
    now, once, again = None, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)

    def row() -> Iterator[pa.RecordBatch]:
        if now is not None and again.any():
            bits = np.packbits(again, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})

    for b in batches:
        for block, one, more in zip(b.column("block").to_pylist(), b.column("once"), b.column("again"), strict=True):
            if block != now:
                yield from row()
                now, once, again = block, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            one, more = np.frombuffer(one.as_buffer(), "<u2"), np.frombuffer(more.as_buffer(), "<u2")
            again[one[once[one]]] = True
            again[more] = True
            once[one] = True
            once[more] = True
    yield from row()


def _probe(sha: Column, n_blocks: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(sha), F.lit(n_blocks)).alias("block"), F.xxhash64(sha, F.lit("cell")).alias("h")


def repeated_filter(digests: DataFrame, n_rows: int, bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """Pass 1 over a column `sha`: (block, bits) rows of the filter of hashes that may repeat, and the number of blocks."""
    n_blocks = max(1, min(-(-bits_per_row * n_rows // BLOCK_BITS), max_filter_bits // BLOCK_BITS))
    cells = digests.select(*_probe(F.col("sha"), n_blocks)).mapInArrow(tidy(_cells), "block long, once binary, again binary")
    merged = cells.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_merge), "block long, bits array<long>")
    return stash(merged, "bloom"), n_blocks


def may_repeat(df: DataFrame, sha: str, bloom: tuple[DataFrame, int], flag: str) -> DataFrame:
    """Pass 2: df with a boolean column `flag`; false only where no other row has the digest."""
    bits, n_blocks = bloom
    block, h, held = fresh(df, "block"), fresh(df, "hash"), fresh(df, "bits")
    b, hashed = _probe(F.col(sha), n_blocks)
    df = df.withColumns({block: b, h: hashed})
    df = df.join(F.broadcast(bits.select(F.col("block").alias(block), F.col("bits").alias(held))), block, "left")  # at most max_filter_bits
    hit = F.lit(True)
    for j in range(PROBES):
        cell = f"(shiftrightunsigned(`{h}`, {15 * j}) & {BLOCK_BITS - 1})"
        hit &= F.expr(f"(shiftright(`{held}`[cast(shiftright({cell}, 6) as int)], cast({cell} & 63 as int)) & 1) = 1")
    return df.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(block, h, held)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after normalised(); null counts as empty. Of a group the smallest id stays; null
    ids come after all others, and of rows with the same text and id one is kept. An empty table gives an empty result.
    """
    digests = stash(df.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    rows = may_repeat(digests, "sha", repeated_filter(digests, digests.count(), bits_per_row, max_filter_bits), "maybe")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = rows.where("maybe").groupBy("sha").agg(first, F.count("*").alias("group_size"))
    groups = stash(groups.select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
    # both sides are read as they are stored, so that Spark can split a large group's rows
    copies = rows.where("maybe").join(groups, "sha").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(copies)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> DataFrame:
    """df without exact copies: all columns, of each group the row with the smallest id (nulls last). Rows that the filter clears are not shuffled."""
    sha, maybe, row = fresh(df, "sha"), fresh(df, "maybe"), fresh(df, "row")
    digests = stash(df.select(F.sha2(normalised(F.col(text_col)), 256).alias("sha")), "digests")
    bloom = repeated_filter(digests, digests.count(), bits_per_row, max_filter_bits)
    rows = may_repeat(df.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)), sha, bloom, maybe)
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(id_col).isNull(), F.col(id_col)))
    chosen = rows.where(F.col(maybe)).groupBy(sha).agg(first.alias(row)).select(f"{row}.*")
    return rows.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(chosen)
