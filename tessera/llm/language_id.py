"""Language identification by a linear-chain conditional random field over the words of a text.

Each word's features are its letters with the place's neighbours (one, two and three bytes, the word's edges among them, which
makes the outer ones its affixes), prefixes and suffixes of four bytes, and the word itself (a hashed lexicon). Weights for
features and for transitions between labels are learned together by stochastic gradients of the conditional likelihood. Labels'
posteriors come from the forward-backward recursion over the whole text. Every word gets its most probable label; runs of words of
one label are the operator's real output (label_runs()), and a text's language is the one with the largest mean posterior over the
words that have a letter.

The classifier is fitted on the driver on a bounded sample of labelled rows: per language about `sample_docs` distinct texts (by
hash), of each three runs of `sample_run` words and at most `sample_bytes` bytes; some are joined to runs of another language, since
real texts switch. The `languages` languages with most texts are learned (a setting that bounds the model); rows of others teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import _chains, _words
from tessera.llm._io import fresh, stash, tidy

UNKNOWN = "und"
GRAM_BITS, LEXICON_BITS = 15, 17
TEMPLATES = 5  # one, two and three bytes at each letter; affixes of four bytes at a word's ends
FEATURES = TEMPLATES * (1 << GRAM_BITS) + (1 << LEXICON_BITS)
PART_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ANY_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    languages: int = 200
    sample_docs: int = 500
    sample_run: int = 48
    sample_bytes: int = 1 << 16
    epochs: int = 4
    rate: float = 0.15
    l2: float = 1e-6
    seed: int = 11


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, L)
    moves: np.ndarray  # (L, L)
    start: np.ndarray  # (L,)


def _grams(w: _words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers at each byte of a word (bytes, 3), at each word (words, 3), and each word's first byte among the former."""
    n = w.end - w.start
    first = np.cumsum(n + 1) - n  # in the words' bytes with a 0 before each word and at the end
    inner = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    flat = np.zeros(int((n + 1).sum()) + 1, np.uint64)
    flat[inner] = _LOWER[w.data[np.repeat(w.start - np.cumsum(n) + n, n) + np.arange(n.sum())]]

    def numbered(h: np.ndarray, template: int) -> np.ndarray:
        return (_words.mix(h * np.uint64(8) + np.uint64(template + 1)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + template * (1 << GRAM_BITS)

    before, here, after = flat[inner - 1], flat[inner], flat[inner + 1]
    at_bytes = np.stack([numbered(here, 0), numbered(before * np.uint64(256) + here, 1), numbered((before * np.uint64(256) + here) * np.uint64(256) + after, 2)], 1)
    head, tail = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for j in range(4):
        long = n > j
        head = head * np.uint64(256) + np.where(long, flat[np.minimum(first + j, len(flat) - 1)], np.uint64(0))
        tail = tail * np.uint64(256) + np.where(long, flat[first + np.maximum(n - 1 - j, 0)], np.uint64(0))
    lexicon = (_words.fingerprints(w) >> np.uint64(64 - LEXICON_BITS)).astype(np.int64) + TEMPLATES * (1 << GRAM_BITS)
    return at_bytes, np.stack([numbered(head, 3), numbered(tail, 4), lexicon], 1), np.cumsum(n) - n


def _scores(t: Tagger, w: _words.Words) -> np.ndarray:
    """(words, L): each word's score for each label; features are held for PART_BYTES of the words at a time."""
    out = np.empty((len(w.start), len(t.labels)), np.float32)
    for i, j in _words.slices(w.end - w.start, PART_BYTES):
        at_bytes, at_words, first = _grams(w._replace(data=w.data[: w.end[j - 1]], start=w.start[i:j], end=w.end[i:j]))
        per_byte = t.weights[at_bytes[:, 0]] + t.weights[at_bytes[:, 1]] + t.weights[at_bytes[:, 2]]
        out[i:j] = np.add.reduceat(per_byte, first, axis=0) + t.weights[at_words].sum(1)
    return out


def _potentials(t: Tagger, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the start, of moves, and of words for their scores."""
    e = scores.astype(np.float64)
    e = np.exp(e - e.max(1, keepdims=True))
    return np.exp(t.start - t.start.max()), np.exp(t.moves - t.moves.max()), np.maximum(e, 1e-30)


def _posteriors(t: Tagger, lay: _chains.Layout, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By time: the labels' posteriors, and the expected moves."""
    start, move, e = _potentials(t, scores[lay.at])
    p, _, moves = _chains.forward_backward(lay, np.broadcast_to(start, (len(lay.order), len(t.labels))), move, e)
    return p, moves


def fit(runs: list[tuple[str, str]], s: Settings) -> Tagger:
    """From (label, text) runs of words; adaptive gradients over batches of sequences."""
    labels = sorted({label for label, _ in runs})
    n = len(labels)
    t = Tagger(labels, np.zeros((FEATURES, n), np.float32), np.zeros((n, n)), np.zeros(n))
    if n < 2:
        return t
    rng, number = np.random.Generator(np.random.PCG64(s.seed)), {x: i for i, x in enumerate(labels)}
    texts = pa.array([x for _, x in runs])
    w = _words.split(*_words.raw(texts))
    tags = np.repeat([number[x] for x, _ in runs], w.counts)
    at_bytes, at_words, first_byte = _grams(w)
    n_bytes = w.end - w.start
    sums, move_sums, start_sums = np.full((FEATURES, n), 1e-4, np.float32), np.full((n, n), 1e-4), np.full(n, 1e-4)
    for _ in range(s.epochs):
        order = rng.permutation(len(runs))
        for i in range(0, len(order), 64):
            # sequences of one run or, one time in three, of two
            parts, k = [], i
            while k < min(i + 64, len(order)):
                step = 2 if rng.random() < 1 / 3 else 1
                parts.append(order[k : min(k + step, i + 64, len(order))])
                k += step
            words = [np.concatenate([np.arange(w.first[r], w.first[r + 1]) for r in part]) for part in parts]
            words = [x for x in words if len(x)]
            if not words:
                continue
            own = np.concatenate(words)
            first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
            nb = n_bytes[own]
            bytes_ = np.repeat(first_byte[own] - np.cumsum(nb) + nb, nb) + np.arange(nb.sum())
            f_bytes, f_words = at_bytes[bytes_], at_words[own]
            scores = np.add.reduceat(t.weights[f_bytes].sum(1), np.cumsum(nb) - nb, axis=0) + t.weights[f_words].sum(1)
            lay = _chains.layout(first)
            p, moves = _posteriors(t, lay, scores)
            wrong = np.empty_like(p)
            wrong[lay.at] = p
            wrong[np.arange(len(own)), tags[own]] -= 1  # the gradient at each word
            moved = np.zeros((n, n))
            inside = np.ones(len(own), bool)
            inside[first[:-1]] = False
            np.add.at(moved, (tags[own][:-1][inside[1:]], tags[own][1:][inside[1:]]), 1)
            size = len(words)
            flat = np.concatenate([f_bytes.ravel(), f_words.ravel()])
            grads = np.concatenate([np.repeat(np.repeat(wrong, nb, axis=0), 3, axis=0), np.repeat(wrong, 3, axis=0)])
            used, back = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(back, grads[:, j], len(used)) for j in range(n)], 1) / size + s.l2 * t.weights[used]
            sums[used] += (g * g).astype(np.float32)
            t.weights[used] -= (s.rate * g / np.sqrt(sums[used])).astype(np.float32)
            g = (moves - moved) / size
            move_sums += g * g
            t.moves -= s.rate * g / np.sqrt(move_sums)
            g = wrong[first[:-1]].sum(0) / size
            start_sums += g * g
            t.start -= s.rate * g / np.sqrt(start_sums)
    return t


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """True where crc32 of the id as text leaves the remainder `fold`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(rows: DataFrame, s: Settings) -> Tagger:
    """From the columns text and lang of rows; rows without a language or a word teach nothing, nor do those of languages beyond the `languages` with most texts (ties by name)."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    hashed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    # per language the hash below which about sample_docs distinct texts lie, by counts of 1024 parts of the hashes
    part = F.shiftrightunsigned("h", 54)
    counts = stash(hashed.groupBy("lang", part.alias("part"), "h").agg(F.lit(1).alias("one")).groupBy("lang", "part").agg(F.count("*").alias("n")), "parts")
    learned = counts.groupBy("lang").agg(F.sum("n").alias("texts")).orderBy(F.col("texts").desc(), "lang").limit(s.languages)
    counts = counts.join(F.broadcast(learned.select("lang")), "lang")
    parts: dict[str, list[tuple[int, int]]] = {}
    for r in counts.collect():  # at most 1024 rows a language
        parts.setdefault(r["lang"], []).append((r["part"], r["n"]))
    most = []
    for lang, own in parts.items():
        left, bound = s.sample_docs, (1 << 63) - 1
        for k, n in sorted(own):
            if n >= left:
                bound = min(bound, int((k + left / n) * (1 << 53)))  # of the hash's upper 63 bits
                break
            left -= n
        most.append((lang, bound))
    least = rows.sparkSession.createDataFrame(most, "lang string, most long")
    # one text of each hash, so that copies do not fill the sample
    chosen = hashed.join(F.broadcast(least), "lang").where(F.shiftrightunsigned("h", 1) <= F.col("most")).dropDuplicates(["lang", "h"])  # a row per language
    words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    n, run = F.size("w"), s.sample_run
    starts = F.array_distinct(F.array(F.lit(1), F.greatest(F.lit(1), F.floor((n - run) / 2).cast("int")), F.greatest(F.lit(1), n - run + 1)))
    cut = F.array_join(F.slice("w", F.col("at"), run), " ")
    runs = chosen.select("lang", "h", words.alias("w")).withColumn("at", F.explode(starts)).select("lang", "h", "at", F.substring(cut, 1, s.sample_bytes).alias("run"))
    found = runs.toPandas().sort_values(["lang", "h", "at"])  # about 3 x sample_docs runs a language
    return fit(list(zip(found["lang"], found["run"], strict=True)), s)


_OUT = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double"), ("n_words", pa.int64(), "long"), ("switches", pa.int64(), "long")]


class Judged(NamedTuple):
    """For texts i:j: best (the label's number, the last for und), its mean posterior, the words; of each word its label and that one's posterior."""

    i: int
    j: int
    best: np.ndarray
    score: np.ndarray
    words: _words.Words
    label: np.ndarray
    sure: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        """The first words of runs of one label."""
        new = np.ones(len(self.label), bool)
        new[1:] = (self.label[1:] != self.label[:-1]) | (self.words.doc[1:] != self.words.doc[:-1])
        return np.flatnonzero(new)


def _judged(t: Tagger, texts: pa.Array) -> Iterator[Judged]:
    for i, j, w in _words.batches(texts, PART_BYTES):
        n, doc = j - i, w.doc
        mean, counted = np.zeros((n, len(t.labels))), np.zeros(n)
        label, sure = np.zeros(len(w.start), np.int64), np.zeros(len(w.start))
        letters = np.bincount(np.searchsorted(w.offsets, np.flatnonzero(_LETTER[w.data]), side="right") - 1, minlength=n) > 0
        for k in np.flatnonzero(letters):  # bytes beyond ASCII may be no letters
            own = w.data[w.offsets[k] : w.offsets[k + 1]]
            if not _LETTER[own[own < 128]].any() and not _ANY_LETTER.search(texts[i + int(k)].as_py()):
                letters[k] = False
        if len(w.start) and t.labels:
            p = _chains.posteriors(w.first, *_potentials(t, _scores(t, w)))
            ink = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
            weight = (ink[w.end] > ink[w.start]).astype(float)
            counted = np.bincount(doc, weight, n)
            mean = np.stack([np.bincount(doc, p[:, c] * weight, n) for c in range(len(t.labels))], 1) / np.maximum(counted, 1)[:, None]
            label = p.argmax(1)
            sure = p[np.arange(len(p)), label]
        known = letters & (counted > 0)
        best = np.where(known, mean.argmax(1) if t.labels else 0, len(t.labels))
        score = np.where(known, np.clip(mean.max(1, initial=0.0), 0, 1), 0.0)
        yield Judged(i, j, best, score, w, label, sure)


def _predict(t: Tagger, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*t.labels, UNKNOWN], object)
        for b in batches:
            for g in _judged(t, b.column(b.num_columns - 1)):
                kept = [b.column(c).slice(g.i, g.j - g.i) for c in range(b.num_columns - 1)]
                runs = np.bincount(g.words.doc[g.begins], minlength=g.j - g.i)
                switches = np.maximum(runs - 1, 0) * bool(t.labels)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[g.best], pa.string()), pa.array(g.score), pa.array(g.words.counts.astype(np.int64)), pa.array(switches)], schema=schema)

    return run


_RUNS = [("run", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")]


def _label_runs(t: Tagger, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(t.labels, object)
        for b in batches:
            for g in _judged(t, b.column(b.num_columns - 1)):
                at = g.begins
                if not len(at) or not t.labels:
                    continue
                doc, size = g.words.doc[at], np.diff(np.append(at, len(g.label)))
                first = at - g.words.first[doc]
                kept = [b.column(c).take(pa.array(doc + g.i)) for c in range(b.num_columns - 1)]
                nth = np.arange(len(at)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(nth), pa.array(first), pa.array(first + size - 1), pa.array(names[g.label[at]], pa.string()), pa.array(np.add.reduceat(g.sure, at) / size)], schema=schema)

    return run


def least_score(languages: int, margin: float) -> float:
    """The mean posterior asked for: `margin` of the way from chance, 1 / languages, to 1."""
    return 1 / languages + margin * (1 - 1 / languages)


def _accept(t: Tagger, margin: float, text_at: int):
    known = len(t.labels)
    judge = t if known else Tagger([UNKNOWN], np.zeros((FEATURES, 1), np.float32), np.zeros((1, 1)), np.zeros(1))  # any letter will do
    least = least_score(known, margin) if known > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in _judged(judge, b.column(text_at)):
                yield b.slice(g.i, g.j - g.i).filter(pa.array((g.best < len(judge.labels)) & (g.score >= least)))

    return run


def accept(df: DataFrame, tagger: Tagger, margin: float, text_col: str = "text") -> DataFrame:
    """df, all columns, without the texts that are in no language: null, without a letter, or with no mean posterior of least_score().

    The best of n mean posteriors is never below 1 / n, so the margin counts from there. A tagger of one language or of none has
    nothing to tell texts apart by: all with a letter stay.
    """
    return df.mapInArrow(tidy(_accept(tagger, margin, df.columns.index(text_col))), df.schema)


def _by_text(df: DataFrame, tagger: Tagger, keep: list[str | Column], text_col: str, out: list[tuple], run) -> DataFrame:
    rows = df.select(*keep)
    kept = [(f.name, f.dataType) for f in rows.schema.fields]
    taken = {n.lower() for n, _ in kept}
    names = [fresh(rows, n) if n in taken else n for n, *_ in out]
    schema = pa.schema([*((n, to_arrow_type(k)) for n, k in kept), *((n, k) for n, (_, k, _) in zip(names, out, strict=True))])
    spark_schema = ", ".join([*(f"`{n}` {k.simpleString()}" for n, k in kept), *(f"`{n}` {k}" for n, (*_, k) in zip(names, out, strict=True))])
    return df.select(*keep, F.col(text_col).cast("string").alias(fresh(rows, "text"))).mapInArrow(tidy(run(tagger, schema)), spark_schema)


def predict(df: DataFrame, tagger: Tagger, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred (`und` for null and for texts without a letter), score (mean posterior of lang_pred; 0 for und), n_words, and switches of label between neighbouring words.

    Here and in label_runs(), where `keep` has a column named like one of these, the latter's name begins with an underscore.
    """
    return _by_text(df, tagger, keep, text_col, _OUT, _predict)


def label_runs(df: DataFrame, tagger: Tagger, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The words' labels: the columns `keep`, and for each run of words of one label run, first_word, last_word (all from 0), lang_pred and score (the words' mean posterior).

    A text without a word has no run, nor has any text where no language was learned.
    """
    return _by_text(df, tagger, keep, text_col, _RUNS, _label_runs)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of df: doc_id, held_out, lang_pred, score, n_words, switches.

    Learns only from text and language of rows that held_out() leaves; predictions see the text alone. If no row teaches a
    language, all texts are `und`; with a single language it is that one wherever there is a letter. Of more than
    `languages` languages those with most texts are learned. An empty table gives an empty result; repeated rows are predicted each.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    tagger = train(rows.where(~held_out(F.col("doc_id"))).select("text", "lang"), settings)
    return predict(rows, tagger, ["doc_id", held_out(F.col("doc_id")).alias("held_out")], "text")
