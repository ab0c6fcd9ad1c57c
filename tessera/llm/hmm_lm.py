"""A hidden Markov language model over word classes, with an exact unigram base beneath it.

Counting reads all training documents: a 64-bit fingerprint stands for each word, tasks pre-aggregate, and a shuffle adds up
(fingerprint, suffix class, count). The `own_classes` most frequent words are classes of their own; any other word, seen or not,
is in one of SUFFIXES classes, to which its last two bytes are hashed. The model of a text is

    P(classes, by the hidden Markov model) * product of P(word | its class),

where P(word | class) is the word's smoothed unigram probability over that of its whole class, one unseen word included, so all
probabilities of a class add up to one. Baum-Welch learns the Markov part: each task runs scaled forward and backward
recursions over its documents and emits expected counts, which Spark adds up over all tasks; the driver holds only the model,
states x (states + classes + 2) numbers. For that part documents are cut into pieces of `piece_tokens` words, each token in one
of them; scoring runs the forward recursion over whole documents, so the likelihood is exact.

The most frequent fingerprints and counts, at most `frequent_words` + `own_classes` of them, are broadcast (16 bytes each); the counts of
all others reach their documents by a shuffle. What Baum-Welch learns has that fixed number of classes at any size of input; all word
counts, and so each word's share of its class, grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import _chains, _words
from tessera.llm._io import stash

SUFFIXES = 256
END = np.uint64(0)  # the end token's fingerprint; no word has it
HELD_TOKENS = 1 << 18  # of one chunk of the recursions


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own_classes: int = 1024
    frequent_words: int = 1 << 17
    iterations: int = 4
    piece_tokens: int = 256
    add: float = 0.1
    seed: int = 7


@dataclass
class Model:
    """start: of a document and of a later piece (2, K); move (K, K); emit (K, C)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _suffix(w: _words.Words) -> np.ndarray:
    """A word's last two bytes, A-Z lower-cased, hashed to one of SUFFIXES classes; so some endings share one."""
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    last = lower[w.data[w.end - 1]]
    before = np.where(w.end - w.start > 1, lower[w.data[np.maximum(w.end - 2, 0)]], 0)
    return ((last * 167 + before * 59 + 11) % SUFFIXES).astype(np.int32)


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """True where crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


# --- counting -------------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's training texts: word, suffix, n; the end token as word 0, once a text."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = np.concatenate([h[0] for h in held])
        at = np.argsort(word, kind="stable")
        word = word[at]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return word[first], np.concatenate([h[1] for h in held])[at][first], np.add.reduceat(np.concatenate([h[2] for h in held])[at], first)

    def rows() -> Iterator[pa.RecordBatch]:
        word, suffix, n = merged()
        for i in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[i : i + 100_000].view(np.int64)), "suffix": pa.array(suffix[i : i + 100_000], pa.int32()), "n": pa.array(n[i : i + 100_000], pa.int64())})

    for b in batches:
        for i, j, w in _words.batches(b.column(0)):
            held.append((np.append(_words.fingerprints(w), END), np.append(_suffix(w), 0), np.append(np.ones(len(w.start), np.int64), j - i)))
            size += len(w.start) + 1
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from rows()
                    held, size = [], 0
    if held:
        yield from rows()


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, suffix, n) over all rows of texts: fingerprints, and one row for the end token."""
    pairs = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "word long, suffix int, n long")
    return pairs.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


# --- the vocabulary ---------------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Frequent words, sorted by fingerprint: word, n, and own (their class, or -1); mass: by class, the base probability of all its words."""

    tokens: int
    distinct: int
    end: int
    word: np.ndarray
    n: np.ndarray
    own: np.ndarray
    mass: np.ndarray
    add: float

    @property
    def total(self) -> float:
        return self.tokens + self.add * (self.distinct + 1)

    @property
    def classes(self) -> int:
        return len(self.mass)


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = counts.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the frequent words: whole steps of the count (16 to a doubling), as many as fit, so that no task sends a list of its own
    step = F.floor(16 * F.log2("n")).cast("int")
    steps = sorted(counts.where("word <> 0").groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True)
    fit = np.cumsum([v for _, v in steps]) <= s.frequent_words
    least = min([k for (k, _), f in zip(steps, fit, strict=True) if f], default=10_000)
    listed = counts.where((F.col("word") != 0) & (step >= least)).select("word", "suffix", "n").toPandas()
    # words of their own are the most frequent ones whatever the steps hold; each task sends its own_classes at most
    alone = counts.where("word <> 0").orderBy(F.col("n").desc(), "word").limit(s.own_classes).select("word", "suffix", "n").toPandas()
    top = pd.concat([alone, listed]).drop_duplicates("word").sort_values(["n", "word"], ascending=[False, True])
    by_suffix = counts.where("word <> 0").groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    own = np.where(np.arange(len(top)) < s.own_classes, np.arange(len(top)), -1)
    total = tokens + s.add * (distinct + 1)
    # classes: the end, then suffixes, then words of their own
    mass = np.full(1 + SUFFIXES + int((own >= 0).sum()), s.add / total)
    mass[0] = (end + s.add) / total
    mass[1 + by_suffix["suffix"].to_numpy(int)] += (by_suffix["n"].to_numpy(float) + s.add * by_suffix["v"].to_numpy(float)) / total
    alone = own >= 0
    base = (top["n"].to_numpy(float) + s.add) / total
    np.add.at(mass, 1 + top["suffix"].to_numpy(int)[alone], -base[alone])
    mass[1 + SUFFIXES + own[alone]] = base[alone]
    mass = np.maximum(mass, s.add / total)
    word = top["word"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(word)
    return Vocabulary(int(tokens), int(distinct), int(end), word[at], top["n"].to_numpy(np.int64)[at], np.where(own >= 0, 1 + SUFFIXES + own, -1)[at], mass, s.add)


_ENCODED = pa.schema([("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("seq", pa.binary()), ("rare", pa.binary()), ("rare_suffix", pa.binary())])


def _encode(v: Vocabulary, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), *_ENCODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_base = np.log10((v.n + v.add) / v.total)
        end_base, log_mass = np.log10((v.end + v.add) / v.total), np.log10(v.mass)
        for b in batches:
            for i, j, w in _words.batches(b.column(3)):
                h, doc, n = _words.fingerprints(w), w.doc, j - i
                at = np.minimum(np.searchsorted(v.word, h), max(0, len(v.word) - 1))
                known = v.word[at] == h if len(v.word) else np.zeros(len(h), bool)
                at = at[known]
                suffix = _suffix(w) if len(h) else np.zeros(0, np.int32)
                kind = 1 + suffix
                alone = v.own[at] >= 0
                kind[np.flatnonzero(known)[alone]] = v.own[at][alone]
                base = np.bincount(doc[known], log_base[at], n) + end_base
                within = np.bincount(doc[known], np.where(alone, 0.0, log_base[at] - log_mass[kind[known]]), n)
                seq = np.insert(kind, w.first[1:], 0).astype("<u2")  # the end token closes each document
                first = w.first + np.arange(n + 1)
                rare, rare_first = h[~known], np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=n))])
                rare_suffix = suffix[~known].astype(np.uint8)
                put = lambda a, at: pa.array([a[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                columns = [b.column(0)[i:j], b.column(1)[i:j], b.column(2)[i:j], pa.array(w.counts + 1), pa.array(np.bincount(doc[known], minlength=n) + (v.end > 0)), pa.array(base), pa.array(within), put(seq, first), put(rare, rare_first), put(rare_suffix, rare_first)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


# --- the recursions ---------------------------------------------------------------------------------------------------


def forward(m: Model, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence tokens[first[i]:first[i + 1]], by the scaled forward recursion."""
    order, alive, *_ = _chains.layout(first)
    emit, out, total = np.ascontiguousarray(m.emit.T), np.zeros(len(order)), np.zeros(len(order))
    begin = first[:-1][order]
    a = np.broadcast_to(m.start[0], (len(order), len(m.move)))
    for t, n in enumerate(alive):
        a = (a[:n] @ m.move if t else a[:n]) * emit[tokens[begin[:n] + t]]
        c = a.sum(1)
        a = a / c[:, None]
        total[:n] += np.log(c)
    out[order] = total
    return out


def expected(m: Model, tokens: np.ndarray, first: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts (2, K), moves (K, K), emissions (K, C) and the log-likelihood of the sequences; later: those that begin inside a document."""
    k, classes = m.emit.shape
    lay = _chains.layout(first)
    x, begun = tokens[lay.at], later[lay.order].astype(int)
    posterior, scale, moves = _chains.forward_backward(lay, m.start[begun], m.move, np.ascontiguousarray(m.emit.T)[x])
    starts = np.zeros((2, k))
    np.add.at(starts, begun[: lay.place[1] if len(lay.alive) else 0], posterior[: lay.place[1] if len(lay.alive) else 0])
    emissions = np.stack([np.bincount(x, posterior[:, j], classes) for j in range(k)])
    return starts, moves, emissions, float(np.log(scale).sum())


def _sequences(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    data = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    held = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return held.view("<u2").astype(np.int64), (offsets - offsets[0]) // 2


def _chunks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from _words.slices(np.diff(first), HELD_TOKENS)


def _e_step(m: Model, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, classes = m.emit.shape
        sums, any_rows = np.zeros(2 * k + k * k + k * classes + 1), False
        for b in batches:
            if not b.num_rows:
                continue
            tokens, first = _sequences(b, "seq")
            pieces = np.maximum(1, -(-np.diff(first) // piece))
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cuts = np.append(np.repeat(first[:-1], pieces) + nth * piece, first[-1])
            for i, j in _chunks(cuts):
                starts, moves, emissions, ll = expected(m, tokens[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], nth[i:j] > 0)
                sums += np.concatenate([starts.ravel(), moves.ravel(), emissions.ravel(), [ll]])
            any_rows = True
        if any_rows:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "x": pa.array(sums[at])})

    return run


def initial(v: Vocabulary, s: Settings) -> Model:
    """States that keep to themselves, each with the classes' base probabilities disturbed at random (seeded)."""
    rng, k = np.random.Generator(np.random.PCG64(s.seed)), s.states
    emit = v.mass * rng.gamma(1.0, 1.0, (k, v.classes)) + 1e-12
    move = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    return Model(np.full((2, k), 1 / k), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def baum_welch(encoded: DataFrame, v: Vocabulary, s: Settings) -> tuple[Model, list[float]]:
    """The model after s.iterations passes over all rows of encoded (column seq), and each pass's mean log10-likelihood a token."""
    m, k, seen = initial(v, s), s.states, []
    for _ in range(s.iterations):
        rows = encoded.select("seq").mapInArrow(_e_step(m, s.piece_tokens), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        sums = np.zeros(2 * k + k * k + k * v.classes + 1)
        sums[rows["at"].to_numpy(int)] = rows["x"]
        if not len(rows):
            break
        starts, moves, emissions = sums[: 2 * k].reshape(2, k), sums[2 * k : 2 * k + k * k].reshape(k, k), sums[2 * k + k * k : -1].reshape(k, v.classes)
        seen.append(sums[-1] / np.log(10) / max(1.0, emissions.sum()))
        emissions = emissions + 0.5 * v.mass * k  # so that no class is impossible
        m = Model((starts + 0.1) / (starts + 0.1).sum(1, keepdims=True), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emissions / emissions.sum(1, keepdims=True))
    return m, seen


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens, first = _sequences(b, "seq")
            ll = np.concatenate([forward(m, tokens[first[i] : first[j]], first[i : j + 1] - first[i]) for i, j in _chunks(first)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "held_out", "n_tokens", "n_known", "base", "within")), pa.array(ll / np.log(10))], names=["doc_id", "row", "held_out", "n_tokens", "n_known", "base", "within", "markov"])

    return run


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, suffix, doc, times) of the words that are not among the frequent ones."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            c = b.slice(i, 512)
            word, suffix = np.frombuffer(b"".join(c.column("rare").to_pylist()), np.uint64), np.frombuffer(b"".join(c.column("rare_suffix").to_pylist()), np.uint8)
            lengths = np.array([len(x.as_buffer()) // 8 for x in c.column("rare")], np.int64)
            if not len(word):
                continue
            doc = np.repeat(np.arange(len(c)), lengths)
            at = np.lexsort((word, doc))
            word, suffix, doc = word[at], suffix[at], doc[at]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[first].view(np.int64)), "suffix": pa.array(suffix[first].astype(np.int32)), "row": c.column("row").take(pa.array(doc[first])), "times": pa.array(np.diff(np.append(first, len(word))), pa.int32())})


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, markov_score.

    Scores are log10 probabilities of whole texts. Rows whose crc32(id as text) is divisible by `folds` are held out of all
    counts and of the training; rows with a null id are trained on. A null text is empty: its end token alone. With no training
    row at all every word is unseen. An empty table gives an empty result. Rows are told apart by where they stand in the
    stored table, so repeated ids and texts do no harm.
    """
    s = settings
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = stash(count_words(rows.where(~held_out(F.col("doc_id"), folds))), "counts")
    v = vocabulary(counts, s)
    kind = rows.schema["doc_id"].dataType
    held = f"doc_id {kind.simpleString()}, row long, held_out boolean, n_tokens long, n_known long, base double, within double"
    keyed = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    encoded = stash(keyed.mapInArrow(_encode(v, to_arrow_type(kind)), f"{held}, seq binary, rare binary, rare_suffix binary"), "encoded")
    model, _ = baum_welch(encoded.where("not held_out"), v, s)

    scored = encoded.drop("rare", "rare_suffix").mapInArrow(_score(model), f"{held}, markov double")
    rare = encoded.select("row", "rare", "rare_suffix").mapInArrow(_rare, "word long, suffix int, row long, times int")
    found = rare.join(counts.select("word", "n"), "word", "left")
    log_mass = F.element_at(F.lit([float(x) for x in np.log10(v.mass[1 : 1 + SUFFIXES])]), F.col("suffix") + 1)
    base = F.log10((F.coalesce("n", F.lit(0)) + F.lit(v.add)) / F.lit(v.total))
    found = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("k"), F.sum(base * F.col("times")).alias("b"), F.sum((base - log_mass) * F.col("times")).alias("w"))
    zero = F.lit(0.0)
    return scored.join(found, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("markov") + F.col("within") + F.coalesce("w", zero)).alias("score"), F.col("markov").alias("markov_score"))
