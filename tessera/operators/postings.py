"""An inverted index of documents: where each word stands, how often, and the most of each block of documents.

postings() makes the rows of the words asked for; build_index() stores those of all words in segments, each of some documents and sorted
by word, so that a search reads the pages of its own words only. Searches over either give the same rows. top_matches() ends early: the most that a block of
documents could score is known from its words' highest counts, and blocks that cannot reach a question's k-th score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.joins import fits, small
from tessera.sources.scratch import stash

BLOCK_IDS = 1024  # neighbouring ids that make a block
PUSHED_TERMS = 1000  # asked words up to which they are pushed to the scan as a list
FIRST_BLOCKS = 4  # of a question, which are searched before the others are judged
SLICE_TOKENS = 500_000  # tokens that a task groups at once, or one text's

# Fixed values of the positional rank: a plain word's weight, how closeness counts, and the sum of 1 / n^2.
WEIGHT, FAR, FAR_CLOSENESS, ZETA = 0.1, 100, 1e-30, 1.64493406685


def postings(documents: DataFrame, terms: DataFrame | None = None, places: bool = False, forms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf[, places]) of documents (id, text): how often, and as which of its tokens (from 1), a document has each term.

    terms: (term) asked for, all with None. forms: (word, term), what each word counts as; words without a row, or with a null term,
    are left out, though they keep their places. A null text has no token.
    """
    tokens = T.tokens(F.col("text"))
    if places:
        key = documents.select("id").schema["id"].dataType.simpleString()
        rows = documents.select("id", tokens.alias("tokens")).mapInArrow(_with_places, f"term string, id {key}, tf long, places array<int>")
    else:
        rows = documents.select("id", F.explode(tokens).alias("term"))
    if forms is not None:
        rows = rows.withColumnRenamed("term", "word").join(small(forms.where("term IS NOT NULL")), "word").drop("word")
    if terms is not None:
        rows = rows.join(small(terms), "term", "left_semi")
    if not places:
        return rows.groupBy("term", "id").agg(F.count("*").alias("tf"))
    if forms is None and documents.groupBy("id").count().where("count > 1").isEmpty():
        return rows  # else several rows of a document may have a term
    return rows.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id, tf, places) of rows (id, tokens), a row's tokens grouped where they are, so that no token is shuffled."""
    for batch in batches:
        ids, tokens = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ids):
            before = ends[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            if ends[end - 1] > before:
                yield _grouped(ids.slice(start, end - start), tokens.slice(start, end - start).flatten(), sizes[start:end])
            start = end


def _grouped(ids: pa.Array, tokens: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    """_with_places() of rows of so many tokens each, which follow one another."""
    words = tokens.dictionary_encode()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(1, len(tokens) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = words.indices.to_numpy() * np.int64(len(sizes)) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # a term's first place in a row
    bounds = np.append(first, len(key))
    terms = words.dictionary.take(pa.array(key[first] // len(sizes)))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[order], pa.int32()))
    return pa.RecordBatch.from_arrays([terms, ids.take(pa.array(key[first] % len(sizes))), pa.array(np.diff(bounds)), lists], ["term", "id", "tf", "places"])


@dataclass
class Index:
    """postings: (term, id, tf, places); blocks: (term, block, n, most), the documents of a block that have the term and its highest tf there."""

    postings: DataFrame
    blocks: DataFrame

    def of(self, terms: DataFrame) -> Index:
        """What a search for these terms (term) reads; many are not pushed to the postings, which it then joins by words or documents of its own."""
        asked = [r["term"] for r in terms.limit(PUSHED_TERMS + 1).collect()]  # at most so many words
        if len(asked) <= PUSHED_TERMS:
            return Index(self.postings.where(F.col("term").isin(asked)), self.blocks.where(F.col("term").isin(asked)))
        return Index(self.postings, self.blocks.join(small(terms), "term", "left_semi"))

    def held(self, asked: Asked) -> DataFrame:
        """Postings, with places where they are needed."""
        return self.postings.drop("places") if asked.plain else self.postings


def _block() -> Column:
    return F.floor(F.col("id") / BLOCK_IDS)


def _blocks(held: DataFrame) -> DataFrame:
    return held.groupBy("term", _block().alias("block")).agg(F.count("*").alias("n"), F.max("tf").alias("most"))


def build_index(documents: DataFrame, path: str, forms: DataFrame | None = None) -> Index:
    """Store the index of documents (id, text) under path, in segments of some blocks of documents (of some rows of blocks) sorted by term and id (term and block)."""
    rows = postings(documents.repartition(_block()), places=True, forms=forms)
    rows.sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    held = documents.sparkSession.read.parquet(f"{path}/postings")
    _blocks(held).sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
    return open_index(documents.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/blocks"))


@dataclass
class Asked:
    """Parsed questions, stored. need: (qid, alt, size, term), a row a wanted word; terms: (term), all words, also those excluded; few: whether need is small; plain: no phrase and no exclusion."""

    rows: DataFrame
    need: DataFrame
    terms: DataFrame
    few: bool
    plain: bool

    @classmethod
    def of(cls, parsed: DataFrame) -> Asked:
        """parsed: (qid, alt, words, phrases, unwanted), as search.parsed() gives them."""
        rows = stash(parsed, "asked")
        need = stash(rows.select("qid", "alt", F.size("words").alias("size"), F.explode("words").alias("term")), "need")
        plain = rows.where("size(phrases) + size(unwanted) > 0").isEmpty()
        terms = need.select("term")
        if not plain:
            terms = terms.union(rows.select(F.explode(F.flatten(F.transform("unwanted", lambda p: F.split(p, " "))))).where("col <> ''"))
        return cls(rows, need, stash(terms.distinct(), "terms"), fits(need), plain)

    def words(self) -> DataFrame:
        """(qid, term): what a question wants, in all its alternatives."""
        return self.need.select("qid", "term").distinct()


def _candidates(held: DataFrame, asked: Asked, count: DataFrame | None = None) -> DataFrame:
    """(qid, alt, size, id), stored: the documents of each alternative's rarest word. count: (term, n), in how many documents a word is, if known."""
    if count is None:
        count = held.join(small(asked.terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))  # no more rows than words are asked for
    order = F.struct(F.coalesce("n", F.lit(0)), "term")
    first = asked.need.join(small(count, asked.few), "term", "left").groupBy("qid", "alt", "size").agg(F.min_by("term", order).alias("term"))
    return stash(held.join(small(first, asked.few), "term").select("qid", "alt", "size", "id"), "candidates")


def _with_phrases(fit: DataFrame, held: DataFrame, asked: Asked) -> DataFrame:
    """Those of fit whose documents have all phrases of their alternative and nothing that it excludes, told by places."""
    told = lambda wanted: lambda p: F.struct(F.lit(wanted).alias("wanted"), F.split(p, " ").alias("words"))
    checks = asked.rows.select("qid", "alt", F.posexplode(F.concat(F.transform("phrases", told(True)), F.transform("unwanted", told(False)))).alias("no", "check"))
    checks = checks.select("qid", "alt", "no", "check.wanted", F.size(F.filter("check.words", lambda w: w != "")).alias("size"), F.posexplode("check.words").alias("offset", "term")).where("term <> ''")  # an empty word holds a place
    rows = fit.join(small(checks), ["qid", "alt"]).join(held, ["term", "id"])
    starts = F.collect_list(F.transform("places", lambda p: p - F.col("offset")))
    rows = rows.groupBy("qid", "alt", "id", "no", "wanted", "size").agg(starts.alias("starts"))  # as many arrays as the phrase has words
    common = F.reduce(F.slice("starts", F.lit(2), F.size("starts")), F.element_at("starts", 1), lambda a, b: F.array_intersect(a, b))
    rows = rows.where((F.size("starts") == F.col("size")) & (F.size(common) > 0))
    rows = rows.groupBy("qid", "alt", "id").agg(F.count_if("wanted").alias("has"), F.count_if(~F.col("wanted")).alias("bad"))
    wants = asked.rows.select("qid", "alt", F.size("phrases").alias("wants"))
    rows = fit.join(small(wants, asked.few), ["qid", "alt"]).join(rows, ["qid", "alt", "id"], "left")
    return rows.where((F.coalesce("has", F.lit(0)) == F.col("wants")) & (F.coalesce("bad", F.lit(0)) == 0)).select("qid", "alt", "id")


def fitting(held: DataFrame, asked: Asked, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, id) of all that fits an alternative of a question, and the postings of all documents that came into question, both stored.

    held: postings of at least the asked words, with places, unless all are plain. Documents meet an alternative under its rarest word (found:
    those of _candidates() to be judged); other words are looked up in the postings of these documents alone, no others are shuffled.
    """
    found = _candidates(held, asked) if found is None else found
    near = held.join(small(found.select("id").distinct()), "id", "left_semi").join(small(asked.terms), "term", "left_semi")
    near = stash(near.select(held.columns), "near")
    others = found.join(small(asked.need.drop("size"), asked.few), ["qid", "alt"]).join(near.select("term", "id"), ["term", "id"])
    fit = others.groupBy("qid", "alt", "id", "size").agg(F.count("*").alias("hits")).where("hits = size").select("qid", "alt", "id")
    if not asked.plain:
        fit = _with_phrases(stash(fit, "fits"), near, asked)
    return stash(fit.select("qid", "id").distinct(), "fits"), near


def scored(fit: DataFrame, held: DataFrame, asked: Asked) -> DataFrame:
    """(qid, id, score): the sum of log(1 + tf) over all words that a question wants."""
    rows = fit.join(small(asked.words(), asked.few), "qid").join(held.select("term", "id", "tf"), ["term", "id"])
    return rows.groupBy("qid", "id").agg(F.round(F.sum(F.log1p("tf")), 9).alias("score"))


def postings_for(documents: DataFrame, asked: Asked, places: bool | None = None, forms: DataFrame | None = None) -> DataFrame:
    """Stored postings of the asked words alone, for documents (id, text) that have no index."""
    return stash(postings(documents, asked.terms, not asked.plain if places is None else places, forms), "postings")


def match_documents(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """(qid, id, score) of all documents (id, text) that fit parsed questions."""
    asked = Asked.of(parsed)
    return scored(*fitting(postings_for(documents, asked), asked), asked)


def match_index(index: Index, parsed: DataFrame) -> DataFrame:
    """match_documents() of an index."""
    asked = Asked.of(parsed)
    return scored(*fitting(index.of(asked.terms).held(asked), asked), asked)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_matches(index: Index, parsed: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of match_index(), ties to the least id, without judging blocks that cannot hold one.

    A block can hold a match of an alternative only if it has all its words, and no document there can score more than the sum of
    log(1 + highest tf) over the question's words. The FIRST_BLOCKS best blocks give each question a k-th score, and only blocks
    that can reach it are searched after those; the result is exact.
    """
    asked = Asked.of(parsed)
    own = index.of(asked.terms)
    held, of_words = own.held(asked), stash(own.blocks, "blocks")
    found = _candidates(held, asked, of_words.groupBy("term").agg(F.sum("n").alias("n"))).withColumn("block", _block())
    met = of_words.join(small(asked.words(), asked.few), "term").join(small(found.select("qid", "block").distinct()), ["qid", "block"], "left_semi")
    bound = met.groupBy("qid", "block").agg(F.sum(F.log1p("most")).alias("bound"))
    met = of_words.join(small(asked.need, asked.few), "term").join(small(found.select("qid", "alt", "block").distinct()), ["qid", "alt", "block"], "left_semi")
    whole = met.groupBy("qid", "alt", "size", "block").agg(F.count("*").alias("hits")).where("hits = size")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("bound").desc(), "block"))
    blocks = stash(bound.join(whole.select("qid", "block").distinct(), ["qid", "block"]).withColumn("nth", nth), "bounds")
    judged = lambda some: scored(*fitting(held, asked, found.join(small(some.select("qid", "block")), ["qid", "block"], "left_semi").drop("block")), asked)
    first = stash(judged(blocks.where(F.col("nth") <= FIRST_BLOCKS)), "first")
    least = _best(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = blocks.where(F.col("nth") > FIRST_BLOCKS).join(small(least), "qid", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-9 >= F.col("least")))
    return _best(first.unionByName(judged(rest)), k)


def closeness(distance: np.ndarray) -> np.ndarray:
    """How much two words so many places apart count together."""
    return np.where(distance > FAR, FAR_CLOSENESS, 1 / (1.005 + 0.05 * np.exp(np.minimum(distance, FAR) / 1.5 - 2)))


_NEAR = np.log1p(-WEIGHT * np.sqrt(closeness(np.arange(FAR + 1.0))))
_BEYOND = float(np.log1p(-WEIGHT * np.sqrt(FAR_CLOSENESS)))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """Over all pairs of places of two different words: the sum of log(1 - what the pair adds to the rank). Linear in both, whatever their lengths."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    if len(a) * len(b) <= 1 << 16:
        d = np.abs(a[:, None] - b).ravel()
        d = d[d <= FAR]
        near, total = len(d), float(_NEAR[d].sum())
    else:  # by distance, in the sorted places of the longer one
        a, b = (a, np.sort(b)) if len(a) <= len(b) else (b, np.sort(a))
        total, near = 0.0, 0
        for step in range(-FAR, FAR + 1):
            n = int((np.searchsorted(b, a + step, "right") - np.searchsorted(b, a + step)).sum())
            total, near = total + n * float(_NEAR[abs(step)]), near + n
    return total + (len(a) * len(b) - near) * _BEYOND


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([apart(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ranked(fit: DataFrame, held: DataFrame, asked: Asked) -> DataFrame:
    """(qid, id, rank): the positional rank of documents that fit (qid, id), 0 to 1; held: postings with places.

    A question of one alternative with several words: 1 minus the product, over all pairs of places of two of its words, of 1 - 0.1
    x sqrt(closeness). Any other: of each word with n places 0.1 x (1 + 1/4 + ... + 1/n^2) / (pi^2 / 6), averaged over its words.
    """
    several = asked.need.groupBy("qid").agg(F.countDistinct("alt").alias("alternatives"), F.countDistinct("term").alias("size"))
    words = asked.words().join(several, "qid").select("qid", "term", "size", ((F.col("alternatives") == 1) & (F.col("size") > 1)).alias("together"))
    rows = stash(fit.join(small(words, asked.few), "qid").join(held, ["term", "id"]), "places")
    of = lambda term, places: rows.where("together").select("qid", "id", F.col("term").alias(term), F.col("places").alias(places))
    pairs = of("a", "x").join(of("b", "y"), ["qid", "id"]).where("a < b")  # two words of one question
    near = pairs.select("qid", "id", F.pandas_udf(_apart, "double")("x", "y").alias("part")).groupBy("qid", "id").agg((-F.expm1(F.sum("part"))).alias("rank"))
    sums = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("tf")), F.lit(0.0), lambda t, n: t + 1 / (n * n).cast("double"))
    single = rows.where("NOT together").groupBy("qid", "id", "size").agg(F.sum(sums).alias("part")).select("qid", "id", (F.lit(WEIGHT / ZETA) * F.col("part") / F.col("size")).alias("rank"))
    return near.unionByName(single)
