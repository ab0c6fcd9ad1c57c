"""Hybrid retrieval, set-at-a-time over many questions: legs, boost, fusion, region dedupe, floor, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.joins import small
from tessera.functions.vectors import matrix
from tessera.sources.scratch import stash

RRF_K = 60
LEG, FUSED, FINAL, PER_DOCUMENT, FLOOR = 20, 10, 5, 3, 0.2
QUERY_BLOCK, CORPUS_BLOCK = 2048, 1 << 16  # questions whose vectors a task holds at once; vectors that a block of the grid meets


class Best:
    """The k nearest of a block of questions among the vectors seen so far; ties go to the least id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, q, k, metric
        self.unit = q / self._length(q)
        self.held = np.zeros((3, 0))  # question's number, id (as the bits of a double), rounded distance

    @staticmethod
    def _length(v: np.ndarray) -> np.ndarray:
        return np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)  # a zero vector is at distance 1

    def see(self, cid: np.ndarray, x: np.ndarray) -> None:
        d = 1 - self.unit @ (x / self._length(x)).T if self.metric == "cosine" else np.sqrt(np.maximum(0, (self.q * self.q).sum(1)[:, None] + (x * x).sum(1) - 2 * self.q @ x.T))
        self.keep(cid, d)

    def keep(self, cid: np.ndarray, d: np.ndarray, met: np.ndarray | None = None) -> None:
        """Take vectors cid at distances d, a row a question; met: only those that a question meets."""
        d = np.round(d, 9)
        cut = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] if d.shape[1] > self.k else np.inf
        q, c = np.nonzero(d <= cut if met is None else (d <= cut) & met)
        rows = np.stack([q.astype(np.float64), cid[c].view(np.float64), d[q, c]])
        self.held = self._least(np.hstack([self.held, rows]))

    def _least(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[:, np.lexsort((np.ascontiguousarray(rows[1]).view(np.int64), rows[2], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        return rows[:, np.arange(rows.shape[1]) - first < self.k]

    def batch(self) -> pa.RecordBatch:
        q, c, d = self.held
        return pa.RecordBatch.from_pydict({"qid": pa.array(self.ids[q.astype(np.int64)]), "id": pa.array(np.ascontiguousarray(c).view(np.int64)), "distance": pa.array(d)})


def _in_one_block(ids: np.ndarray, q: np.ndarray, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, q, k, metric)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                best.see(c.column(0).to_numpy(), matrix(c.column(1)))
        yield best.batch()

    return run


def _in_grid(k: int, metric: str):
    """Rows (cell, side, id, embedding) sorted by cell and side: of each cell the questions come first and are held, the vectors stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, asked = None, None, []
        for b in batches:
            cell, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if cell[lo] != now:
                    if best is not None:
                        yield best.batch()
                    now, best, asked = cell[lo], None, []
                ids, x = b.column(2).slice(lo, hi - lo).to_numpy(), matrix(b.column(3).slice(lo, hi - lo))
                if side[lo] == 0:
                    asked.append((ids, x))
                    continue
                if best is None and asked:
                    best = Best(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), k, metric)
                for at in range(0, len(ids) if best is not None else 0, 2048):
                    best.see(ids[at : at + 2048], x[at : at + 2048])
        if best is not None:
            yield best.batch()

    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): of a stated set of queries (qid, embedding), the k nearest rows of corpus (id, embedding).

    Up to QUERY_BLOCK queries go to every task, and the corpus stays where it is. More make a grid: blocks of queries by blocks of
    the corpus, each cell in one task, which holds one block of queries and streams the vectors. Either way a task keeps its k best
    a query, and what is shuffled after that is tasks x queries x k.
    """
    held = queries.where(F.col("embedding").isNotNull()).select(F.col("qid").cast("long").alias("qid"), "embedding")
    vectors = corpus.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    schema, few = "qid long, id long, distance double", held.limit(QUERY_BLOCK + 1).count()
    if few == 0:
        out = corpus.sparkSession.createDataFrame([], schema)
    elif few <= QUERY_BLOCK:
        asked = held.toPandas()  # at most QUERY_BLOCK rows
        out = vectors.mapInArrow(_in_one_block(asked["qid"].to_numpy(np.int64), np.stack(asked["embedding"]).astype(np.float64), k + skip_self, metric), schema)
    else:
        across, down = -(-held.count() // QUERY_BLOCK) * 2, -(-vectors.count() // CORPUS_BLOCK) * 2  # blocks by hash: half full, so none is much too large
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        left = held.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda x: block("qid", across) * down + x)).alias("cell"), F.lit(0).alias("side"), F.col("qid").alias("id"), "embedding")
        right = vectors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda x: block("id", down) + x * down)).alias("cell"), F.lit(1).alias("side"), "id", "embedding")
        out = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_in_grid(k + skip_self, metric), schema)
    if skip_self:
        out = out.where("qid <> id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def page_boost(leg: DataFrame, page: Column, wanted: Column) -> DataFrame:
    """Ranks anew with rows of the page asked for first; nothing changes where none is asked for."""
    first = F.when(wanted.isNotNull() & page.eqNullSafe(wanted), 0).otherwise(1)
    return leg.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(first, "rank")))


def rrf(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, id, score, position): reciprocal rank fusion of legs (qid, id, rank); ties keep the order of first appearance."""
    rows = None
    for i, leg in enumerate(legs):
        part = leg.select("qid", "id", "rank", F.lit(i).alias("leg"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seen")
    return fused.withColumn("position", F.row_number().over(order)).select("qid", "id", "score", "position")


def dedupe_regions(fused: DataFrame, region: Column) -> DataFrame:
    """The first row of each region; rows without a region all stay."""
    key = F.coalesce(F.concat(F.lit("r"), region.cast("string")), F.concat(F.lit("i"), F.col("id").cast("string")))
    nth = F.row_number().over(Window.partitionBy("qid", key).orderBy("position"))
    kept = fused.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("position")))


def diversify(ranked: DataFrame, document: str, top: int = FINAL, most: int = PER_DOCUMENT) -> DataFrame:
    """At most `most` rows of a document among the first `top`; if too few are left, the passed-over ones follow in order."""
    nth = F.row_number().over(Window.partitionBy("qid", document).orderBy("position"))
    late = F.when(nth <= most, 0).otherwise(1)
    rows = ranked.withColumn("_late", late)
    final = F.row_number().over(Window.partitionBy("qid").orderBy("_late", "position"))
    return rows.withColumn("final", final).where(F.col("final") <= top).drop("_late")


Relevance = Callable[[DataFrame], DataFrame]


def overlap(documents: DataFrame, questions: DataFrame) -> Relevance:
    """A scorer of candidates (qid, id): (qid, id, relevance), the share of a question's distinct words (qid, text) that a document (id, text) has; stands in for a hosted reranker. Only candidates' texts are read into words."""

    def score(candidates: DataFrame) -> DataFrame:
        words = questions.select("qid", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
        pairs = candidates.select("qid", "id").join(small(words), "qid")
        held = documents.select("id", "text").join(pairs, "id").select("qid", "id", "words", T.tokens(F.col("text")).alias("held"))
        return held.select("qid", "id", F.coalesce(F.try_divide(F.size(F.array_intersect("words", "held")), F.size("words")), F.lit(0.0)).alias("relevance"))

    return score


def legs_by_provider(legs: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """The concatenation of the providers' legs (qid, id, rank); one whose set-up fails is left out, and None is left if all do."""
    out = None
    for make in legs.values():
        try:
            leg = make()
        except ConnectionError:
            continue
        out = leg if out is None else out.unionByName(leg)
    return out


def merged_rows(legs: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of all legs, one a key: the last leg's row wins."""
    rows = None
    for i, leg in enumerate(legs):
        part = leg.withColumn("_leg", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_leg").desc()))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_leg")


def with_context(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """rows (region, content) whose content is followed by what their regions' contexts add: expanded (region, position, content), in order, each text once. Rows without a region stay as they are."""
    more = expanded.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]).alias("_more"))
    texts = F.concat(F.array("content"), F.coalesce("_more", F.array().cast("array<string>")))
    whole = F.array_join(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))), "\n\n")
    return rows.join(more, "region", "left").withColumn("content", F.when(F.col("_more").isNull(), F.col("content")).otherwise(whole)).select(*rows.columns)


def with_captions(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """rows (document, content): where there is no content, the document's caption (document, caption), if it has one."""
    none = F.coalesce(F.trim("content"), F.lit("")) == ""
    one = captions.groupBy("document").agg(F.min("caption").alias("_caption"))
    return rows.join(one, "document", "left").withColumn("content", F.when(none, F.coalesce("_caption", "content")).otherwise(F.col("content"))).select(*rows.columns)


def to_enrich(rows: DataFrame, most: int = 4) -> DataFrame:
    """(qid, id, region): of each question's rows (qid, id, position, region, region_type, content) the first visual regions without content."""
    empty = rows.where(F.col("region").isNotNull() & F.col("region_type").isin("image", "chart", "table") & (F.coalesce(F.trim("content"), F.lit("")) == ""))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("position"))
    return empty.withColumn("_nth", nth).where(F.col("_nth") <= most).select("qid", "id", "region")


@dataclass(frozen=True)
class Evidence:
    """What retrieve() may know of chunks beyond ids and documents.

    chunks: (id, document, page, region, region_type, content), one row an id; region is null for what is no region. asked: (qid, page) of the
    questions that name a page. describe: gives (region, caption) for (region) of visual regions without content that a question came
    upon, as a vision model would. context: (region, position, content) around regions. captions: (document, caption), for documents'
    chunks that are left without content.
    """

    chunks: DataFrame
    asked: DataFrame | None = None
    describe: Callable[[DataFrame], DataFrame] | None = None
    context: DataFrame | None = None
    captions: DataFrame | None = None

    def boosted(self, leg: DataFrame) -> DataFrame:
        """A leg with the page that its question names first; see page_boost()."""
        if self.asked is None:
            return leg
        asked = self.asked.groupBy("qid").agg(F.min("page").alias("_asked"))
        rows = leg.join(self.chunks.select("id", F.col("page").alias("_page")), "id", "left").join(small(asked), "qid", "left")
        return page_boost(rows, F.col("_page"), F.col("_asked")).select("qid", "id", "rank")

    def deduped(self, fused: DataFrame) -> DataFrame:
        rows = fused.join(self.chunks.select("id", F.col("region").alias("_region")), "id", "left")
        return dedupe_regions(rows, F.col("_region")).drop("_region")

    def read(self, top: DataFrame) -> DataFrame:
        """Candidates (qid, id, position) with document, region, content (enriched, with its context, or its document's caption) and evidence, the lines that a scorer reads."""
        rows = top.join(self.chunks.select("id", "document", "page", "region", "region_type", "content"), "id")
        if self.describe is not None:
            wanted = to_enrich(rows)
            told = self.describe(wanted.select("region").distinct()).groupBy("region").agg(F.min("caption").alias("_caption"))
            rows = rows.join(wanted.join(told, "region").select("qid", "id", "_caption"), ["qid", "id"], "left").withColumn("content", F.coalesce("_caption", "content")).drop("_caption")
        if self.context is not None:
            rows = with_context(rows, self.context)
        if self.captions is not None:
            rows = with_captions(rows, self.captions)
        none = F.lit(None).cast("string")
        lines = T.serialize_evidence(none, none, F.col("page"), F.col("region_type"), F.col("content"))
        return rows.withColumn("evidence", F.when(F.col("region").isNotNull(), lines).otherwise(F.col("content")))


def overlap_with_evidence(questions: DataFrame) -> Relevance:
    """As overlap(), of what candidates (qid, id, evidence) were given to read."""

    def score(candidates: DataFrame) -> DataFrame:
        asked = questions.select("qid", F.array_distinct(T.tokens(F.col("text"))).alias("_words"))
        rows = candidates.select("qid", "id", T.tokens(F.col("evidence")).alias("_held")).join(asked, "qid")
        return rows.select("qid", "id", F.coalesce(F.try_divide(F.size(F.array_intersect("_words", "_held")), F.size("_words")), F.lit(0.0)).alias("relevance"))

    return score


def retrieve(legs: list[DataFrame | None], documents: DataFrame | Evidence, relevance: DataFrame | Relevance | None, region: Column | None = None, sealed: DataFrame | None = None, require_relevance: bool = False) -> DataFrame:
    """(qid, id, document, relevance, final), with Evidence also content: the whole pipeline over many questions.

    legs: (qid, id, rank) each, None for one that failed; the others carry, and without any only sealed matches are left. documents:
    (id, document), or Evidence: then legs put a page asked for first, regions come once, and candidates are read with descriptions, context
    and captions before they are judged. relevance: (qid, id, relevance) or a scorer that gives it of candidates, None if the scorer is down: then
    the fused order stands with relevance 1 and no floor, or, with require_relevance, an error. sealed: (qid, id, document[, content]) of exact
    matches, appended past the cut.
    """
    if relevance is None and require_relevance:
        raise RuntimeError("relevance is required, but there is no scorer")
    told = isinstance(documents, Evidence)
    there, spark = [leg for leg in legs if leg is not None], (documents.chunks if told else documents).sparkSession
    columns = ["qid", "id", "document", "relevance", "final"] + ["content"] * told
    out = None
    if there:
        fused = rrf([documents.boosted(leg) for leg in there] if told else there)
        if told:
            fused = documents.deduped(fused)
        elif region is not None:
            fused = dedupe_regions(fused, region)
        top = fused.where(F.col("position") <= FUSED)
        if told:  # a few rows a question, which are judged and shown
            top = stash(documents.read(top).select("qid", "id", "position", "document", "content", "evidence"), "candidates")
        if relevance is None:
            scored = top.withColumn("relevance", F.lit(1.0))
        else:
            judged = relevance(top) if callable(relevance) else relevance
            scored = top.join(judged, ["qid", "id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0))).where(F.col("relevance") >= FLOOR)
        ranked = scored.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("relevance").desc(), "position")))
        out = diversify(ranked if told else ranked.join(documents.select("id", "document"), "id"), "document").select(*columns)
    if sealed is not None:
        nth = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
        more = sealed.select("qid", "id", "document", F.lit(1.0).alias("relevance"), (F.lit(FINAL) + nth).alias("final"), *["content"] * told)
        out = more if out is None else out.unionByName(more)
    return out if out is not None else spark.createDataFrame([], "qid long, id long, document string, relevance double, final int" + ", content string" * told)


def scoped(rows: DataFrame, questions: DataFrame, k: int = FINAL, floor: float = FLOOR) -> DataFrame:
    """(qid, scope, id, relevance, rank): each question (qid, scope, text) within its scope alone: of its rows (id, text, scope) the k most relevant at or above the floor, by the share of the question's distinct words that a text has. Nothing comes from other scopes."""
    asked = questions.select("qid", "scope", F.array_distinct(T.tokens(F.col("text"))).alias("_words"))
    held = rows.select("id", "scope", T.tokens(F.col("text")).alias("_held")).join(asked, "scope")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_words", "_held")), F.size("_words")), F.lit(0.0))
    found = held.select("qid", "scope", "id", share.alias("relevance")).where(F.col("relevance") >= floor)
    rank = F.row_number().over(Window.partitionBy("qid", "scope").orderBy(F.col("relevance").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def sealed_matches(plain: DataFrame, phrase: str) -> DataFrame:
    """Exact phrase in unlocked text, score 1.0; appended past the cut, never capped."""
    return plain.where(F.contains(F.lower("content"), F.lower(F.lit(phrase)))).select("id", F.lit(1.0).alias("score"))


def evenly_spaced(rows: DataFrame, group: str, order: str, count: int = 5) -> DataFrame:
    """At most `count` rows of each group, at round(i * (n - 1) / (count - 1)), halves to even."""
    w = Window.partitionBy(group)
    rows = rows.withColumns({"_at": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    c = F.least(F.col("_n"), F.lit(count))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.lit(1), c - 1)).cast("long"))
    return rows.where(F.array_contains(wanted, F.col("_at").cast("long"))).drop("_at", "_n")
