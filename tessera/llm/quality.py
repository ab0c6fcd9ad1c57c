"""Quality by hierarchical empirical Bayes.

A classifier gives each document's evidence: its log-odds less the training rate's. Naive Bayes over a text's words and word pairs
(hashed) learns from each half of the training documents and judges the other half, and of other texts the mean of both halves holds;
a logistic regression on that, a word, and on what a text looks like is fitted on all of them. They see about `train_docs` labelled
documents at most, drawn by a hash. Hosts and, within them, paths have rates of their own. Of each, labelled documents count fully and unlabelled ones by `soft` of what the
classifier expects; a path's rate is shrunk towards its host's and a host's towards the global one, by prior strengths that
the method of moments finds in the spread of the groups. A document's posterior log-odds are those of its path's rate plus its
evidence. Everything about groups is a grouped aggregation over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import fresh, small, stash

FEATURES = ["log_words", "word_length", "symbols", "digits", "upper", "ends", "bars", "distinct", "line_words", "repeated_lines", "shouts", "links"]


@dataclass(frozen=True)
class Settings:
    folds: int = 5  # rows whose crc32(id as text) is divisible by it are held out
    soft: float = 0.25
    least_strength: float = 1.0
    most_strength: float = 1000.0
    threshold: float = 0.5
    iterations: int = 30
    hashed: int = 1 << 16  # numbers for words and word pairs
    train_docs: int = 20_000
    smoothing: float = 0.5


def features(text: Column) -> list[Column]:
    """What a text looks like, null as empty; all are finite."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.lit(1), F.length(text))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words, n_lines = F.greatest(F.lit(1), F.size(words)), F.greatest(F.lit(1), F.size(lines))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    values = [
        F.log1p(F.size(words)),
        F.least(F.lit(30.0), chars / n_words),
        share(r"[^\p{L}\p{N}\s.,;:!?'\"-]"),
        share("[0-9]"),
        share(r"\p{Lu}"),
        F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) / n_words,
        share(r"\|"),
        F.size(F.array_distinct(words)) / n_words,
        F.least(F.lit(200.0), n_words / n_lines),
        1 - F.size(F.array_distinct(lines)) / n_lines,
        share("!"),
        F.regexp_count(text, F.lit(r"https?://|@")) / n_words,
    ]
    return [v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)]


def _terms(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (with text) with `terms`: which hashed words and neighbouring pairs the text has."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows.withColumn("words", words))
    rows = rows.withColumn("words", F.concat("words", "pairs")).drop("pairs")
    return HashingTF(inputCol="words", outputCol="terms", numFeatures=s.hashed, binary=True).transform(rows).drop("words")


def _said(model: NaiveBayesModel, rows: DataFrame, name: str) -> DataFrame:
    """rows with what the words say: the model's log-odds, a word."""
    out = model.setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    raw = vector_to_array(F.col("raw"))
    return out.withColumn(name, (raw[1] - raw[0]) / (1 + F.expm1("log_words"))).drop("raw")


def _with_evidence(rows: DataFrame, train: DataFrame, n: int, s: Settings) -> DataFrame:
    """rows (with text) with `evidence`, learned from the n rows of train (doc_id, text, label)."""
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(min(1.0, s.train_docs / max(1, n)) * (1 << 20))
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))  # copies are in one half
    sample = stash(_terms(train.where(drawn).select("label", "text", half.alias("half"), *features(F.col("text"))), s).drop("text"), "train")
    sizes = {(h, y): m for h, y, m in sample.groupBy("half", "label").agg(F.count("*")).collect()}
    m, positive = sum(sizes.values()), sum(k for (_, y), k in sizes.items() if y == 1)
    if not 0 < positive < m:
        return rows.withColumn("evidence", F.lit(0.0))
    rows = rows.select("*", *features(F.col("text")))
    if all(sizes.get((h, y)) for h in (0, 1) for y in (0, 1)):
        words = NaiveBayes(featuresCol="terms", labelCol="label", smoothing=s.smoothing)
        a, b = (words.fit(sample.where(F.col("half") == h)) for h in (0, 1))
        judged = _said(b, sample.where("half = 0"), "said").unionByName(_said(a, sample.where("half = 1"), "said"))
        rows = _said(b, _said(a, _terms(rows, s), "a"), "b").withColumn("said", (F.col("a") + F.col("b")) / 2)
    else:  # too few documents to learn words from
        judged, rows = sample.withColumn("said", F.lit(0.0)), rows.withColumn("said", F.lit(0.0))
    vectors = VectorAssembler(inputCols=[*FEATURES, "said"], outputCol="vector")
    model = LogisticRegression(featuresCol="vector", labelCol="label", maxIter=s.iterations, regParam=1e-4).fit(vectors.transform(judged).select("vector", "label"))
    scored = model.setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("").transform(vectors.transform(rows))
    return scored.withColumn("evidence", vector_to_array(F.col("raw"))[1] - F.log(F.lit(positive / (m - positive))))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, y: str, prior: Column, s: Settings) -> float:
    """Of a beta prior, by moments: groups' rates vary by p (1 - p) (1 + (n - 1) / (strength + 1)) / n about their prior mean p."""
    rate = F.col(y) / F.col(n)
    var = prior * (1 - prior)
    over = groups.where(F.col(n) > 1).agg(F.sum(F.col(n) * (rate - prior) ** 2), F.sum(var), F.sum(var * (F.col(n) - 1))).first()
    if not over or over[2] is None or over[2] <= 0:
        return s.most_strength
    rho = (over[0] - over[1]) / over[2]  # 1 / (strength + 1)
    return s.most_strength if rho <= 0 else min(s.most_strength, max(s.least_strength, 1 / rho - 1))


def _group(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", label_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per row of df: doc_id, host, path, held_out, label (as far as known), evidence, host_rate, path_rate, score (0 to 1), kept (score >= threshold).

    labels: 0 or 1 by id; where they disagree about an id the larger holds. Held-out labels are used nowhere. Null hosts and
    paths are the empty one. Without labels of both kinds evidence is 0 and all rates are the labels' own (0.5 without any). An
    empty table gives an empty result; repeated rows are judged each.
    """
    return _classified(df, labels, id_col, text_col, host_col, path_col, label_col, label_id, settings).drop("text_key")


def _classified(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str = "quality", label_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    s = settings
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = stash(known, "labels")
    rows = df.select(F.col(id_col).alias("doc_id"), _group(F.col(host_col)).alias("host"), _group(F.col(path_col)).alias("path"), F.col(text_col).cast("string").alias("text"))
    seen = rows.join(small(known), "doc_id", "left").withColumn("held_out", held_out(F.col("doc_id"), s.folds))
    train = seen.where(F.col("label").isNotNull() & ~F.col("held_out"))
    n, y = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = (y + 0.5) / (n + 1)
    scored = _with_evidence(seen, train, n, s)
    expected = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.lit(rate)))))
    scored = stash(scored.select("doc_id", _text_key(F.col("text")).alias("text_key"), "host", "path", "held_out", "label", "evidence", expected.alias("expected")), "evidence")

    used = F.col("label").isNotNull() & ~F.col("held_out")
    paths = scored.groupBy("host", "path").agg(F.sum(F.when(used, 1.0).otherwise(s.soft)).alias("n"), F.sum(F.when(used, F.col("label")).otherwise(s.soft * F.col("expected"))).alias("y"), F.sum(used.cast("double")).alias("own_n"), F.sum(F.when(used, F.col("label")).otherwise(0)).cast("double").alias("own_y"))
    paths = stash(paths, "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in ("n", "y", "own_n", "own_y")])
    a = _strength(hosts, "host_own_n", "host_own_y", F.lit(rate), s)
    hosts = hosts.withColumn("host_rate", (F.col("host_y") + a * rate) / (F.col("host_n") + a))
    both = paths.join(hosts.select("host", "host_rate"), "host")
    b = _strength(both, "own_n", "own_y", F.col("host_rate"), s)
    rates = stash(both.select("host", "path", "host_rate", ((F.col("y") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate")), "rates")
    joined = scored.join(small(rates), ["host", "path"])
    score = 1 / (1 + F.exp(-(_logit(F.col("path_rate")) + F.col("evidence"))))
    return joined.select("doc_id", "text_key", "host", "path", "held_out", "label", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= s.threshold).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **more) -> DataFrame:
    """df without the rows that classify() does not keep, all columns. A row's fate is that of its own id, text, host and path, null ids included, so rows that repeat an id are judged each."""
    gone = {c: fresh(df, f"gone_{c}") for c in ("doc_id", "text_key", "host", "path")}
    dropped = _classified(df, labels, id_col, text_col, host_col, path_col, **more).where("not kept")
    dropped = stash(dropped.select(*[F.col(c).alias(name) for c, name in gone.items()]).distinct(), "dropped")
    own = {"doc_id": F.col(id_col), "text_key": _text_key(F.col(text_col)), "host": _group(F.col(host_col)), "path": _group(F.col(path_col))}
    same = [own[c].eqNullSafe(F.col(name)) for c, name in gone.items()]
    return df.join(small(dropped), same[0] & same[1] & same[2] & same[3], "left_anti")
