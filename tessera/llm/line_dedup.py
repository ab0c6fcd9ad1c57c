"""Repeated lines, found by ranges of hashes and given back as compressed bitmaps of the lines to keep.

1. Every line of at least `least_chars` code points (stripped, A-Z lower-cased) becomes a row of its 128-bit hash, document and
   position; no text goes on.
2. The rows are dealt to ranges of (hash, document) and sorted by hash, document (largest first) and position. A task streams its
   range: a hash's first document is the one that keeps its lines; from the moment that `least_documents` documents have been
   seen, all later occurrences are dropped as they pass. A hash with a third of all rows lies in many ranges.
3. Only a range's first and last hash can reach into other ranges. Their counts, two rows a range, are added up and broadcast, and
   decide those few rows (of fewer than `least_documents` documents a range) that their own range could not.
4. Dropped positions become one bitmap a document, which meets the texts: broadcast if all of them are small, else by a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm._io import BROADCAST_ROWS, fresh, stash, tidy
from tessera.llm._words import raw

BLANK = b" \t\n\x0b\x0c\r"
BROADCAST_BYTES = 32 << 20  # of bitmaps


@dataclass(frozen=True)
class Settings:
    least_chars: int = 40
    least_documents: int = 5


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where each line ends: at a newline, and the last at the end of the text."""
    return np.append(np.flatnonzero(data == 10), len(data))


def _keys(least_chars: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column(2))
            for i in range(b.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                end = line_ends(text)
                start = np.append(0, end[:-1] + 1)
                at, digests, held = np.flatnonzero(end - start >= least_chars), [], text.tobytes()
                keep = np.zeros(len(at), bool)
                for k, (x, y) in enumerate(zip(start[at].tolist(), end[at].tolist(), strict=True)):
                    key = held[x:y].strip(BLANK).lower()  # of bytes: A-Z alone
                    if len(key) >= least_chars and (key.isascii() or len(key.decode(errors="replace")) >= least_chars):
                        keep[k] = True
                        digests.append(xxhash.xxh3_128_digest(key))
                n = len(digests)
                if n:
                    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    own = pa.array(np.zeros(n, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).slice(i, 1).take(own), b.column(1).slice(i, 1).take(own), pa.array(at[keep]), pa.array(np.full(n, len(end)))], schema=schema)

    return run


def line_keys(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos, n_lines) of every line that is long enough; pos counts from 0. text_key tells rows of one id apart."""
    text = _text(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = StructType.fromDDL("h1 long, h2 long").add("doc_id", rows.schema["doc_id"].dataType)
    for c in ("text_key", "pos", "n_lines"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(tidy(_keys(least_chars, to_arrow_schema(schema))), schema)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    apart = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return apart.to_numpy(zero_copy_only=False)


class _Open:
    """The hash at the end of what a task has read: its documents so far, and the rows that are not decided yet."""

    def __init__(self, first: bool, least: int):
        self.first, self.least, self.docs, self.held = first, least, 0, []

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Take more rows; gives those that are dropped for certain."""
        doc = rows.column("doc_id")
        if self.docs:
            before = pa.concat_arrays([self.last, doc])
            self.docs += int(_changes(before).sum())
        else:
            self.docs, self.top = 1 + int(_changes(doc).sum()), doc.slice(0, 1)
        self.last = doc.slice(len(doc) - 1)
        self.held.append(rows)
        if self.docs >= self.least:
            later, top = [], []
            for part in self.held:
                is_top = ~_changes(pa.concat_arrays([self.top, part.column("doc_id")])).cumsum().astype(bool)
                later.append(part.filter(pa.array(~is_top)))
                top.append(part.filter(pa.array(is_top)))
            yield from later
            self.held = [t for t in top if t.num_rows] if self.first else []

    def undecided(self, at_end: bool) -> tuple[list[pa.RecordBatch], bool]:
        """Rows that other ranges decide, and whether they need this range's count."""
        if self.first:  # earlier ranges may hold larger documents, so its first one may be none that keeps its lines
            return self.held, True
        if not at_end:
            return [], False
        if self.docs >= self.least:
            return [], True
        return [p.filter(pa.array(_changes(pa.concat_arrays([self.top, p.column("doc_id")])).cumsum() > 0)) for p in self.held], True


def _later(least: int, schema: pa.Schema):
    def given(rows: pa.RecordBatch, docs: int | None, keep_hash: bool) -> pa.RecordBatch:
        n = rows.num_rows
        none = pa.nulls(n, pa.int64())
        columns = [rows.column(c) if keep_hash else none for c in ("h1", "h2")] + [rows.column(c) for c in ("doc_id", "text_key", "pos", "n_lines")]
        return pa.RecordBatch.from_arrays([*columns, none if docs is None else pa.array(np.full(n, docs))], schema=schema)

    def closed(o: _Open, at_end: bool, like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, counted = o.undecided(at_end)
        yield from (given(r, None, True) for r in rows)
        if counted:
            yield given(pa.RecordBatch.from_arrays([o.top if f.name == "doc_id" else like.column(f.name) for f in like.schema], schema=like.schema), o.docs, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, like = None, None  # the open hash, and a row of it
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h = np.stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()])
            new = np.append(True, (h[:, 1:] != h[:, :-1]).any(0))
            start = np.flatnonzero(new)
            end = np.append(start[1:], n)
            lo = 0
            if now is not None and like.column("h1")[0].as_py() == h[0, 0] and like.column("h2")[0].as_py() == h[1, 0]:
                for rows in now.add(b.slice(0, end[0])):
                    yield given(rows, None, False)
                lo = 1
            if lo == len(start):
                continue
            if now is not None:
                yield from closed(now, False, like)
                first = False
            else:  # the range's first hash is open for itself
                first = True
            if first and len(start) > 1:
                now, like = _Open(True, least), b.slice(0, 1)
                for rows in now.add(b.slice(0, end[0])):
                    yield given(rows, None, False)
                yield from closed(now, False, like)
                lo, first = 1, False
            # hashes that begin and end in this batch
            inner = np.zeros(len(start), bool)
            inner[lo:-1] = True
            fresh_doc = new | np.append(True, _changes(b.column("doc_id")))
            number = fresh_doc.cumsum()
            of, docs = new.cumsum() - 1, np.add.reduceat(fresh_doc.astype(np.int64), start)
            drop = (inner & (docs >= least))[of] & (number > number[start][of])
            if drop.any():
                yield given(b.filter(pa.array(drop)), None, False)
            now, like = _Open(first, least), b.slice(start[-1], 1)
            for rows in now.add(b.slice(start[-1])):
                yield given(rows, None, False)
        if now is not None:
            yield from closed(now, True, like)

    return run


def dropped_lines(keys: DataFrame, least_documents: int) -> DataFrame:
    """(doc_id, text_key, pos, n_lines) of the lines of a stored line_keys() that go."""
    along = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    schema = StructType(keys.schema.fields).add("docs", "long")
    rows = keys.repartitionByRange(*along).sortWithinPartitions(*along, "pos")
    rows = stash(rows.mapInArrow(tidy(_later(least_documents, to_arrow_schema(schema))), schema), "later")
    edges = rows.where("docs IS NOT NULL").groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("doc_id").alias("top")).where(F.col("total") >= least_documents)
    plain = ["doc_id", "text_key", "pos", "n_lines"]
    # two rows a range at most
    late = rows.where("docs IS NULL AND h1 IS NOT NULL").join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top"))).select(*plain)
    return rows.where("docs IS NULL AND h1 IS NULL").select(*plain).unionByName(late)


def _bitmaps(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keep = None, None

        def row() -> pa.RecordBatch:
            packed = zlib.compress(np.packbits(keep).tobytes())
            return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([len(keep)]), pa.array([len(keep) - int(keep.sum())]), pa.array([packed])], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            start = np.flatnonzero(np.append(True, _changes(b.column(0)) | _changes(b.column(1))))
            pos = b.column("pos").to_numpy()
            for lo, hi in zip(start, np.append(start[1:], b.num_rows), strict=True):
                head = b.slice(lo, 1).select([0, 1])
                if own is None or not own.equals(head):
                    if own is not None:
                        yield row()
                    own, keep = head, np.ones(b.column("n_lines")[lo].as_py(), bool)
                keep[pos[lo:hi]] = False
        if own is not None:
            yield row()

    return run


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, text_key, n_lines, n_dropped, keep) of the documents that lose a line; keep: packed bits of the lines (a first line's bit is the highest), compressed by zlib.

    A line goes if its key has at least `least_chars` code points and stands in at least `least_documents` documents, of which this
    is not the one with the largest id. Rows of one id are one document there; a null id is one too, the least. text_key
    (xxhash64 of the text) tells rows of one id apart; rows alike in both share a bitmap. An empty table gives an empty result.
    """
    keys = stash(line_keys(df, id_col, text_col, settings.least_chars), "lines")
    gone = dropped_lines(keys, settings.least_documents).distinct()  # rows alike in id and text have the same lines
    schema = StructType().add("doc_id", keys.schema["doc_id"].dataType).add("text_key", "long").add("n_lines", "long").add("n_dropped", "long").add("keep", "binary")
    rows = gone.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    return stash(rows.mapInArrow(tidy(_bitmaps(to_arrow_schema(schema))), schema), "bitmaps")


def kept_text(text: np.ndarray, keep: bytes | None) -> np.ndarray:
    """The bytes of a text's lines that stay, joined by newlines; all of them without a bitmap."""
    if keep is None:
        return text
    end = line_ends(text)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(end)).astype(bool)
    held = np.append(text, np.uint8(10))[np.repeat(bits, np.diff(end, prepend=-1))]  # each line with a newline behind it
    return held[:-1]


def _applied(digest: bool, schema: pa.Schema):
    """digest: lines and the hash in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *own, texts, maps = b.columns
            data, offsets = raw(texts)
            kept = (kept_text(data[x:y], m.as_py()) for x, y, m in zip(offsets[:-1], offsets[1:], maps, strict=True))
            if digest:
                lines = [int(np.count_nonzero(data[x:y] == 10)) + 1 for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                out = [pa.array(lines, pa.int64()), pa.array([hashlib.sha256(k.data).hexdigest() for k in kept], pa.string())]
            else:
                out = [pa.array([k.tobytes() if there else None for k, there in zip(kept, texts.is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *out], schema=schema)

    return run


def _with_bitmaps(rows: DataFrame, id_col: str, text_col: str, settings: Settings) -> tuple[DataFrame, str, str]:
    """rows with their bitmap and number of dropped lines, and those columns' names."""
    bitmaps = line_bitmaps(rows, id_col, text_col, settings)
    own, key, keep, lost = (fresh(rows, c) for c in ("own", "key", "keep", "lost"))
    n, size = bitmaps.agg(F.count("*"), F.sum(F.octet_length("keep"))).first()
    few = n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    bitmaps = bitmaps.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("keep").alias(keep), F.col("n_dropped").alias(lost))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(_text(text_col)) == F.col(key))
    return rows.join(F.broadcast(bitmaps) if few else bitmaps, same, "left").drop(own, key), keep, lost


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of df: doc_id, n_lines (before), n_dropped, kept_sha256 (of what is left). A null or empty text is one empty line."""
    rows, keep, lost = _with_bitmaps(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", settings)
    rows = rows.select("doc_id", F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"), "text", keep)
    schema = StructType().add("doc_id", rows.schema["doc_id"].dataType).add("n_dropped", "long").add("n_lines", "long").add("kept_sha256", "string")
    return rows.mapInArrow(tidy(_applied(True, to_arrow_schema(schema))), schema).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """df, all rows and columns, without the lines that line_bitmaps() drops. Null texts stay null."""
    rows, keep, _ = _with_bitmaps(df, id_col, text_col, settings)
    others = [c for c in df.columns if c != text_col]
    rows = rows.select(*[F.col(f"`{c}`") for c in (*others, text_col)], keep)
    schema = StructType([*(df.schema[c] for c in others)]).add(text_col, "string")
    return rows.mapInArrow(tidy(_applied(False, to_arrow_schema(schema))), schema).select(*[F.col(f"`{c}`") for c in df.columns])
