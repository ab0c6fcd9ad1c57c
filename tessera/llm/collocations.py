"""Phrase collocations: n-grams counted by language, scored by their weakest cut, without those that a longer phrase explains.

1. Every occurrence of every 1- to `most_words`-gram is exploded to a row: a word's with its text, a longer one's as two 64-bit fingerprints, of
   what comes before its last word and of that word. Occurrences are added up in their task, a few million at a time, and hash-aggregated. As a
   phrase is as rare as its rarest part, pairs are made only of frequent words, and longer ones only where all their pairs are frequent:
   Bloom filters of those tell, whose false positives cost rows, never a result.
2. The frequent ones get their texts by joins: a phrase's beginning with its last word. So texts are written once a word and task, and rows
   grow as the input does.
3. The rest is joins of that table: prefix and suffix counts for every cut, scores in decimals, an anti-join with one-word extensions
   (a longer phrase that explains one also has an extension by one word in it that does, as counts only fall), and ranks: the first `top` of each of
   PARTS parts of a language, then of those.

Words are told apart by 64 bits of language and word, pairs by those of both, longer ones by 64 bits of the beginning and the last word's; `_words.py`
states the odds of two sharing a fingerprint. The filters have 16 bits a fingerprint and `max_filter_bits` at most, which bounds what is broadcast; where more fingerprints are frequent
than that holds apart, more rows are shuffled and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _words
from tessera.llm._io import release, small, stash, tidy

PROBES = 4
CELLS = 1 << 15  # of one block of a filter
FLUSH = 1 << 21  # occurrences that a task holds before it adds them up
PARTS = 32
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = np.where(_BREAK, 0x20, np.arange(256)).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    most_words: int = 4
    least: int = 30
    cover_percent: int = 80
    scale: int = 2_000_000
    top: int = 2000
    max_filter_bits: int = 1 << 28


def _joined(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The fingerprint of a phrase, from those of its beginning and its last word."""
    return _words.mix(prefix * np.uint64(0x9E3779B97F4A7C15) + last)


class _Slice:
    """Words of some documents, their fingerprints (with the language), and which of them stand in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.words = _words.split(_PLAIN[data], offsets)
        self.data, self.doc = data, self.words.doc
        self.keys = _words.mix(_words.fingerprints(self.words) ^ langs[self.doc])
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[self.words.start] if len(self.words.start) else np.zeros(0, np.int32)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all n-grams, n > 1: the place of the first word, and the fingerprints of the beginning and of the last word."""
        m = max(0, len(self.keys) - n + 1)
        at = np.flatnonzero((self.piece[:m] == self.piece[n - 1 :]) & (self.doc[:m] == self.doc[n - 1 :])) if m else np.zeros(0, np.int64)
        prefix = self.keys[at]
        for j in range(1, n - 1):
            prefix = _joined(prefix, self.keys[at + j])
        return at, prefix, self.keys[at + n - 1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, list[str], np.ndarray]]:
    """Slices of the texts (lang, text), with their documents' languages and the numbers of those."""
    for b in batches:
        told = pc.dictionary_encode(b.column(0))
        names, number = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False)
        hashed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
        data, offsets = _words.raw(b.column(1))
        for i, j in _words.slices(np.diff(offsets)):
            yield _Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashed[number[i:j]]), names, number[i:j]
        release()


def _counts(pick):
    """(prefix, last, n) of the (prefix, last) that pick(slice) gives."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        prefix, last = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, n = np.unique(_joined(prefix, last), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), pa.array(last[at].view(np.int64)), pa.array(n)], names=["prefix", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for s, *_ in _slices(batches):
            for prefix, last in pick(s):
                held.append((prefix, last))
                size += len(prefix)
            if size > FLUSH:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, last, n) with key, the phrase's own fingerprint."""
    for b in batches:
        key = _joined(b.column("prefix").to_numpy().view(np.uint64), b.column("last").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], names=["key", "prefix", "last", "n"])


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n) of all words."""
    held: dict[int, list] = {}

    def told() -> pa.RecordBatch:
        rows = list(held.values())
        key = pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), key, pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "key", "n"])

    for s, names, number in _slices(batches):
        text, w = _LOWER[s.data].tobytes(), s.words
        key, first, count = np.unique(s.keys, return_index=True, return_counts=True)
        for k, x, y, i, n in zip(key.tolist(), w.start[first].tolist(), w.end[first].tolist(), number[s.doc[first]].tolist(), count.tolist(), strict=True):
            seen = held.get(k)
            if seen is None:
                held[k] = [names[i], text[x:y], n]
            else:
                seen[2] += n
        if len(held) > FLUSH >> 2:
            yield told()
            held = {}
    if held:
        yield told()


# --- filters ------------------------------------------------------------------------------------------------------------


def _probed(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block and cells of each fingerprint."""
    h = _words.mix(keys)
    return (keys % np.uint64(blocks)).astype(np.int64), [((h >> np.uint64(15 * j)) & np.uint64(CELLS - 1)).astype(np.int64) for j in range(PROBES)]


def _marked(blocks: int):
    """Rows come sorted by block; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()])], names=["block", "bits"])
        for b in batches:
            block, cells = _probed(b.column("key").to_numpy().view(np.uint64), blocks)
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            for lo, hi in zip(start, np.append(start[1:], len(block)), strict=True):
                if block[lo] != now:
                    if now is not None:
                        yield row()
                    now, bits = int(block[lo]), np.zeros(CELLS, np.uint8)
                for c in cells:
                    bits[c[lo:hi]] = 1
        if now is not None:
            yield row()

    return run


class Filter:
    """A Bloom filter of a stored table's fingerprints (key), broadcast; at most `most_bits`, a power of two."""

    def __init__(self, keys: DataFrame, most_bits: int):
        blocks = 1 << (min(16 * keys.count(), most_bits - 1) // CELLS).bit_length()
        blocks = max(1, min(blocks, most_bits // CELLS))
        rows = keys.select(F.pmod(F.col("key"), F.lit(blocks)).alias("block"), "key").repartition("block").sortWithinPartitions("block")
        bits = np.zeros((blocks, CELLS // 8), np.uint8)
        for r in rows.select("key").mapInArrow(tidy(_marked(blocks)), "block long, bits binary").toLocalIterator():  # a row of 4 kB a block
            bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        self.blocks, self.bits = blocks, keys.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bits = self.bits.value
        block, cells = _probed(keys, self.blocks)
        hit = np.ones(len(keys), bool)
        for c in cells:
            hit &= (bits[block, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return hit


def _pairs(words: Filter):
    """Pairs of words in the filter."""

    def pick(s: _Slice) -> list[tuple[np.ndarray, np.ndarray]]:
        at, first, last = s.grams(2)
        good = words(s.keys)
        fits = good[at] & good[at + 1]
        return [(first[fits], last[fits])]

    return pick


def _longer(pairs: Filter, most_words: int):
    """Grams of three words and more whose pairs are all in the filter."""

    def pick(s: _Slice) -> list[tuple[np.ndarray, np.ndarray]]:
        at, first, last = s.grams(2)
        good = np.zeros(len(s.keys) + most_words, bool)
        good[at[pairs(_joined(first, last))]] = True
        out = []
        for n in range(3, most_words + 1):
            at, prefix, last = s.grams(n)
            fits = np.ones(len(at), bool)
            for j in range(n - 1):
                fits &= good[at + j]
            out.append((prefix[fits], last[fits]))
        return out

    return pick


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """A stored table (lang, words, phrase, n): all phrases of 1 to `most_words` words that occur at least `least` times in a language; and, with 0 words and a null phrase, the language's word occurrences.

    A-Z are lower-cased; texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words at spaces and tabs. A null language is
    `und`, a null text empty. Overlapping occurrences count, repeated rows each. An empty table has no phrase.
    """
    s = settings
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.mapInArrow(tidy(_all_words), "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    words = stash(words, "words")
    totals = words.groupBy("lang").agg(F.lit(0).alias("words"), F.lit(None).cast("string").alias("phrase"), F.sum("n").alias("n"))
    words = stash(words.where(F.col("n") >= s.least), "often")

    def often(pick, name: str) -> DataFrame:
        found = rows.mapInArrow(tidy(_counts(pick)), "prefix long, last long, n long").groupBy("prefix", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least)
        return stash(found.mapInArrow(tidy(_named), "key long, prefix long, last long, n long"), name)

    pairs = often(_pairs(Filter(words, s.max_filter_bits)), "pairs")
    longer = often(_longer(Filter(pairs, s.max_filter_bits), s.most_words), "longer") if s.most_words > 2 else None
    last = words.select(F.col("key").alias("last"), "word")
    known, out = words.select(F.col("key").alias("prefix"), "lang", F.col("word").alias("phrase")), words.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "n")
    for k in range(2, s.most_words + 1):
        level = (pairs if k == 2 else longer).join(known, "prefix").join(last, "last").select("key", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "n")
        level = stash(level, "told")
        known = level.select(F.col("key").alias("prefix"), "lang", "phrase")
        out = out.unionByName(level.select("lang", F.lit(k).alias("words"), "phrase", "n"))
    return stash(out.unionByName(totals.where("n > 0")), "phrases")


def _part(at: str, n: str) -> Column:
    return F.array_join(F.slice("held", F.expr(at), F.expr(n)), " ")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two words and more, by score, then count, then phrase.

    a: the phrase's occurrences; l, r: those of its parts at the cut that scores lowest (the first of these); score: floor(scale x a / (l +
    r)) there; n: the language's words. A phrase is left out if some longer one that contains it has `cover_percent` of its
    occurrences or more. phrase_counts() says what null, empty and repeated rows give.
    """
    s = settings
    table = phrase_counts(df, lang_col, text_col, s)
    grams = table.where("words > 0")
    totals = table.where("words = 0").select("lang", F.col("n").alias("all_words"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = grams.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("held"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part("1", "k").alias("first"), _part("k + 1", "words - k").alias("rest"))
    of = lambda part, name: grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = cuts.select("lang", "phrase", "words", "a", F.struct(F.expr(f"(cast(a AS decimal(20,0)) * {s.scale}) div (cast(l AS decimal(20,0)) + r)").alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    longer = grams.where("words > 2").select("lang", "words", "n", F.split("phrase", " ", -1).alias("held"))
    longer = longer.select("lang", "n", F.explode(F.array(_part("1", "words - 1"), _part("2", "words - 1"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    covered = stash(longer, "longer").alias("x")
    scored = scored.alias("p")
    same = (F.col("p.lang") == F.col("x.lang")) & (F.col("p.phrase") == F.col("x.phrase")) & (exact("x.longer") * 100 >= exact("p.a") * s.cover_percent)
    left = scored.join(covered, same, "left_anti")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= s.top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= s.top)
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
