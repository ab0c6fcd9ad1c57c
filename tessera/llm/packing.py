"""Best-fit packing: pieces of documents into sequences of a fixed number of tokens.

Documents are encoded where they are read; only their pieces' sizes go on. Runs of RUN_PIECES stored pieces are dealt by a hash to
shards of about `shard_pieces` pieces, however many partitions they come from; in each, best-fit decreasing puts every piece into
the tightest open sequence, which a segment tree over the remaining capacities finds in log2(capacity) steps. Each shard can leave
a few sequences part-filled, so `shard_pieces` trades memory against those.

Along a mix (pack_along()), shards are neighbours in it, and in a shard best-fit decreasing goes over one window of neighbouring
pieces after another: a piece shares a sequence only with its window. Sequences are numbered in the order of their longest pieces
in the mix, so a prefix of the sequences is a prefix of the mix, within a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered
from tessera.llm import _tokens, mixing
from tessera.llm._io import fresh, stash, tidy

CAPACITY = 2048
END_ID = 0
WINDOW_PIECES = 4096
RUN_PIECES = 1 << 12


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: its bin, and its offset there. Lengths are 1 to capacity."""
    size = 1 << capacity.bit_length()
    tree = bytearray(2 * size)  # tree[node]: an open bin has a remaining capacity below that node
    open_bins: list[list[int]] = [[] for _ in range(size)]  # by remaining capacity
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        node = need + size
        if not tree[node]:  # the least capacity above: up until a right sibling has bins, then down to its leftmost
            while node > 1 and (node & 1 or not tree[node ^ 1]):
                node >>= 1
            if node > 1:
                node ^= 1
                while node < size:
                    node = 2 * node + (not tree[2 * node])
        if node > 1:
            room = node - size
            b = open_bins[room].pop()
            if not open_bins[room]:
                while node and tree[node]:
                    tree[node] = 0
                    if node > 1 and tree[node ^ 1]:
                        break
                    node >>= 1
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            if not open_bins[left]:
                node = left + size
                while node and not tree[node]:
                    tree[node] = 1
                    node >>= 1
            open_bins[left].append(b)
    return bins, offsets


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity."""
    at = n % capacity or min(n, capacity)
    yield 0, at
    while at < n:
        yield at, capacity
        at += capacity


def _pieces(path: str, capacity: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            *keys, texts = b.columns
            for own, text in zip(zip(*(c.to_pylist() for c in keys), strict=True), texts, strict=True):
                ids = np.append(_tokens.ids(path, text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    held = ids[start : start + n].tobytes()
                    rows.append((*own, k, start, n, zlib.crc32(held), *([held] if with_ids else [])))
                    size += len(held) if with_ids else 64
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, part: Column | None = None) -> DataFrame:
    """(doc_id[, part], piece, start, length, ids_crc32[, ids]): every text's ids and an end id, whole if it fits, else cut. ids: little-endian unsigned 32-bit; part: the long given."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = tokenizer_path or _tokens.default_path()
    rows = df.select(F.col(id_col).alias("doc_id"), *([] if part is None else [part.cast("long").alias("part")]), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *([] if part is None else [("part", pa.int64())]), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])
    return rows.mapInArrow(tidy(_pieces(path, capacity, with_ids, schema)), f"doc_id {kind.simpleString()}, " + "part long, " * (part is not None) + "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _filled(rows: DataFrame, shard: str, kept: list[str], fill) -> DataFrame:
    """Each shard's columns `kept` with sequence_id and offset, as fill(the shard's rows) gives bins and offsets."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.reset_index(drop=True)
        order, bins, offsets = fill(own)
        return own[kept].iloc[order].assign(sequence_id=(int(own[shard].iloc[0]) << 32) + bins, offset=offsets)

    return rows.groupBy(shard).applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = 1 << 16) -> DataFrame:
    """pieces (with a column length, any others kept) with sequence_id and offset, by best-fit decreasing in shards.

    Sequences have at most capacity tokens and no gaps; ids are unique over all shards. Rows that are alike are packed each. Columns
    sequence_id and offset of pieces are replaced. Where a row stands in pieces decides its shard, so pieces should be a stored table.
    """
    shard, shards = fresh(pieces, "shard"), max(1, -(-pieces.count() // shard_pieces))
    run = F.shiftright(F.monotonically_increasing_id(), RUN_PIECES.bit_length() - 1)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*[F.col(f"`{c}`") for c in kept], F.pmod(F.xxhash64(run), F.lit(shards)).alias(shard))

    def fill(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.arange(len(own)), *best_fit_decreasing(own["length"].to_numpy(), capacity)

    return _filled(rows, shard, kept, fill)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, shard_pieces: int = 1 << 16) -> DataFrame:
    """token_pieces() and pack() of whole documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null text is empty: one piece, the end id alone. An empty table gives an empty result.
    """
    return pack(stash(token_pieces(df, id_col, text_col, capacity, tokenizer_path, with_ids), "pieces"), capacity, shard_pieces)


def fill_along(lengths: np.ndarray, capacity: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """best_fit_decreasing() of each window of at most `window` pieces, all alike in size; bins in the order of their longest pieces."""
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for own in np.array_split(np.arange(len(lengths)), max(1, -(-len(lengths) // window))):
        b, offsets[own] = best_fit_decreasing(lengths[own], capacity)
        openers = np.flatnonzero(offsets[own] == 0)  # a bin's first piece is its longest
        number = np.empty(len(openers), np.int64)
        number[b[openers]] = np.arange(len(openers))
        bins[own] = made + number[b]
        made += len(openers)
    return bins, offsets


def pack_along(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = 1 << 16, window: int = WINDOW_PIECES) -> DataFrame:
    """pieces (with columns slot, at and length, any others kept but slot and at) with sequence_id and offset; sequence_id follows the order of slot and at.

    Pieces are numbered along that order in two levels, and every shard has as many neighbours, so a slot with most of the pieces
    is cut like any others. Null slots come first; ties stand by id and piece. Without pieces there is no row. Columns sequence_id and
    offset of pieces are replaced.
    """
    n = pieces.count()
    per = max(1, -(-n // max(1, -(-n // shard_pieces))))
    kept = [c for c in pieces.columns if c not in ("slot", "at", "sequence_id", "offset")]
    order = ["slot", "at", *[c for c in ("ids_crc32", "piece", "doc_id") if c in kept]]
    nth, shard = fresh(pieces, "nth"), fresh(pieces, "shard")
    rows = numbered(pieces, [], [F.col(c) for c in order], nth, [F.col(f"`{c}`") for c in kept])
    rows = rows.withColumn(shard, F.floor((F.col(nth) - 1) / per))

    def fill(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = own[nth].to_numpy().argsort()
        return at, *fill_along(own["length"].to_numpy()[at], capacity, window)

    return _filled(rows, shard, kept, fill)


def pack_mixed(df: DataFrame, mix: mixing.Settings, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, tokenizer_path: str | None = None, shard_pieces: int = 1 << 16, window: int = WINDOW_PIECES) -> DataFrame:
    """pack_documents() along the mix of df: mixing.mix() gives each row's place from its id, text and source, whatever the order of the rows.

    Rows of one id and text stand at the first one's place.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    pieces = stash(token_pieces(df, id_col, text_col, capacity, tokenizer_path, part=text_hash), "pieces")
    placed = mixing.mix(df, [F.col(id_col).alias("_id"), text_hash.alias("_part")], id_col, text_col, source_col, mix)
    places = placed.groupBy("_id", "_part").agg(F.min(F.struct("slot", "start")).alias("_place"))
    rows = pieces.join(places, pieces["doc_id"].eqNullSafe(places["_id"]) & (pieces["part"] == places["_part"]))
    rows = rows.select(*[c for c in pieces.columns if c != "part"], F.col("_place.slot").alias("slot"), F.col("_place.start").alias("at"))
    return pack_along(stash(rows, "placed"), capacity, shard_pieces, window)
