"""Full-text search in the web style: words are all required, `or` separates alternatives, `-` excludes, quotes ask for a phrase.

Words are lower-case runs of letters, as they are or as English stems without stop words; scores are sums of log(1 + tf) of the
wanted words, or a positional rank. Many questions are searched at once
by an inverted index (operators/postings.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.joins import small
from tessera.functions.stemming import STOP_WORDS, stem
from tessera.operators import postings as P
from tessera.sources.scratch import stash


@dataclass
class Alternative:
    """What one side of an `or` asks for: phrases of one word or more."""

    wanted: list[tuple[str, ...]] = field(default_factory=list)
    unwanted: list[tuple[str, ...]] = field(default_factory=list)


def _letters(text: str) -> tuple[str, ...]:
    return tuple("".join(run) for letters, run in groupby(text.lower(), str.isalpha) if letters)


def web_query(query: str) -> list[Alternative]:
    out = [Alternative()]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            out.append(Alternative())
        elif words := _letters(phrase or word):
            (out[-1].unwanted if minus or word.startswith("-") else out[-1].wanted).append(words)
    return [a for a in out if a.wanted or a.unwanted]


def web_match(text: Column, alternatives: list[Alternative]) -> tuple[Column, Column]:
    """Whether a text fits the query, and its score. A query without a word fits nothing."""
    has = lambda words: F.lower(text).rlike(T.phrase_pattern(words))
    fits = [reduce(lambda a, b: a & b, [*map(has, a.wanted), *(~has(w) for w in a.unwanted)]) for a in alternatives]
    words = dict.fromkeys(w for a in alternatives for phrase in a.wanted for w in phrase)
    score = reduce(lambda a, b: a + b, [F.log1p(T.term_count(text, w)) for w in words], F.lit(0.0))
    return reduce(lambda a, b: a | b, fits, F.lit(False)), score


def web_search(documents: DataFrame, query: str, k: int | None = 20) -> DataFrame:
    """(id, score) of the documents (id, text) that fit; the k best, ties to the least id, or all with k None."""
    fits, score = web_match(F.col("text"), web_query(query))
    found = documents.where(fits).select("id", F.round(score, 9).alias("score"))
    return found if k is None else found.orderBy(F.col("score").desc(), "id").limit(k)


_ALTERNATIVES = "array<struct<words: array<string>, phrases: array<string>, unwanted: array<string>>>"


def parsed(questions: DataFrame, form: Callable[[str], str | None] | None = None) -> DataFrame:
    """(qid, alt, words, phrases, unwanted): the alternatives of questions (qid, text) that want a word. Phrases of two words or more and unwanted ones are joined by spaces.

    form: what a word counts as; one that counts as nothing (null) is neither wanted nor excluded, and an empty word holds its place in a phrase.
    """
    of = lambda p: [(form(w) if form else w) or "" for w in p]

    @F.pandas_udf(_ALTERNATIVES)
    def alternatives(texts: pd.Series) -> pd.Series:
        def each(a: Alternative) -> dict:
            wanted, unwanted = ([p for p in map(of, ps) if any(p)] for ps in (a.wanted, a.unwanted))
            return {"words": list(dict.fromkeys(w for p in wanted for w in p if w)), "phrases": [" ".join(p) for p in wanted if len(p) > 1], "unwanted": [" ".join(p) for p in unwanted]}

        return texts.map(lambda t: [each(a) for a in web_query(t or "")])

    rows = questions.select("qid", F.posexplode(alternatives("text")).alias("alt", "a")).select("qid", "alt", "a.*")
    return rows.where(F.size("words") > 0)


def matching(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, score) of all documents (id, text) that fit one of a question's alternatives, for many questions (qid, text) at once.

    Texts are read once, for the postings of asked words; what is joined grows with the documents of each alternative's rarest word.
    An alternative that only excludes fits nothing here.
    """
    return P.match_documents(documents, parsed(questions))


def best_matches(documents: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """(qid, id, score, rank): the k best of matching(), ties to the least id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return matching(documents, questions).withColumn("rank", rank).where(F.col("rank") <= k)


def english(word: str) -> str | None:
    """What an English word counts as: its stem, and nothing if it is a stop word."""
    return None if word in _STOP else stem(word)


_STOP = frozenset(STOP_WORDS)


def english_forms(documents: DataFrame) -> DataFrame:
    """(word, term) of all distinct words of documents (text); each is stemmed once, however often it occurs. They are stored, as a semi-join by term would else be pushed, stems and all, below distinct()."""
    words = stash(documents.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct(), "words")
    return words.select("word", F.pandas_udf(lambda w: w.map(english), "string")("word").alias("term"))


def ranked_search(documents: DataFrame, questions: DataFrame, in_english: bool = False, k: int | None = None) -> DataFrame:
    """(qid, id, rank[, place]): what fits questions (qid, text) in documents (id, text), by the positional rank; the k best with their place, ties to the least id, or all with k None. in_english: by stems, without stop words."""
    asked = P.Asked.of(parsed(questions, english if in_english else None))
    forms = None
    if in_english:
        forms = english_forms(documents).join(small(asked.terms, asked.few), "term", "left_semi").select("word", "term")
        forms = stash(forms, "forms")
    held = P.postings_for(documents, asked, places=True, forms=forms)
    out = P.ranked(*P.fitting(held, asked), asked).withColumn("rank", F.round("rank", 9))
    if k is None:
        return out
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rank").desc(), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
