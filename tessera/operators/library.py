"""Listings, ownership, captures, renames and wipes of a vault, and the composed clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered
from tessera.operators import graph
from tessera.sources.scratch import stash


def listed(rows: DataFrame, owner: str, order: list[Column], page_rows: int = 5) -> DataFrame:
    """rows with nth (from 1) and page (from 0) in each owner's list, however long it is; the order must be total for pages to be stable. Order by created_at descending for documents, boards, to-dos and sessions, by ordinal or position for what is inside one."""
    rows = numbered(rows, [owner], order, "nth").withColumn("nth", F.col("nth").cast("int"))
    return rows.withColumn("page", F.floor((F.col("nth") - 1) / page_rows).cast("int"))


def merged_meta(left: Column, right: Column) -> Column:
    """Two maps as one: the right one's keys win, nulls among their values too; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def owned(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (user, chunk) of those asked for that the user's tables hold; what is sealed or another's falls away. chunks: (user, chunk)."""
    return asked.select("user", "chunk").distinct().join(chunks.select("user", "chunk"), ["user", "chunk"], "left_semi")


def missing(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are asked for and not found."""
    return asked.select(key).distinct().join(found.select(key), key, "left_anti")


def owned_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links (user, a, b) whose ends are two different chunks (user, chunk) of the user, each pair once, the lesser end first."""
    ends = chunks.select("user", "chunk").distinct()
    pairs = links.select("user", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    for x in ("a", "b"):
        pairs = pairs.join(ends.withColumnRenamed("chunk", x), ["user", x], "left_semi")
    return pairs.select("user", "a", "b")


def toggled(todos: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """todos (id, done, completed_at) after changes (id, done): completing sets the time, reopening clears it; a change without `done`, or to what it is, alters nothing."""
    rows = todos.join(changes.select("id", F.col("done").alias("_to")), "id", "left")
    to = F.coalesce("_to", "done")
    at = F.when(to.eqNullSafe(F.col("done")), F.col("completed_at")).when(to, now)
    return rows.select(*[to.alias(c) if c == "done" else at.alias(c) if c == "completed_at" else F.col(c) for c in todos.columns])


def iso_time(text: Column) -> Column:
    """An ISO 8601 time, with `Z` or an offset, as an instant; null for null and what is no time."""
    return F.try_to_timestamp(text)


def renamed(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """documents (user_id, id, title) after renames asked for (user_id, id, title): only of one's own, trimmed, of 1 to 500 characters."""
    title = F.trim("title")
    good = asked.where(F.length(title).between(1, 500)).groupBy("user_id", "id").agg(F.max(title).alias("_title"))
    rows = documents.join(good, ["user_id", "id"], "left")
    return rows.select(*[F.coalesce("_title", "title").alias(c) if c == "title" else F.col(c) for c in documents.columns])


def wiped(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (each with user_id) without all rows of users (user_id), and (user_id, documents_deleted) for each of them."""
    gone = users.select("user_id").distinct()
    left = {name: t.join(gone, "user_id", "left_anti") for name, t in tables.items()}
    n = tables["documents"].groupBy("user_id").agg(F.count("*").alias("n"))
    return left, gone.join(n, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("documents_deleted"))


def with_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Claimed jobs (document, state) with their documents (document, user_id, status); a job without one is left out."""
    return jobs.join(documents.select("document", "user_id", "status"), "document").select("document", "user_id", "status", "state")


def cluster_documents(chunks: DataFrame, k: int | None = None, iterations: int = 100, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(id, cluster, distance) of the documents of chunks (document, embedding) that have a vector: each one's mean, in k clusters (max(1, round(sqrt(n / 2))) of them unless given), from centres drawn as graph.seeds() says."""
    means = stash(graph.centroids(chunks, "document").withColumnRenamed("document", "id"), "means")
    k = k or max(1, round((means.count() / 2) ** 0.5))
    return graph.kmeans(means, k, iterations, graph.seeds(means, k, rounds, seed))


def satellites(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, satellites): the ordinals of each document's chunks (id, ordinal), in order; an empty array where it is ready without any, null where it is not ready."""
    own = chunks.groupBy("id").agg(F.array_sort(F.collect_list("ordinal")).alias("held"))
    rows = documents.join(own, "id", "left")
    empty = F.array().cast(own.schema["held"].dataType)
    return rows.select("id", F.when(F.col("status") == "ready", F.coalesce("held", empty)).alias("satellites"))


def node_colour(status: Column, mime: Column) -> Column:
    """A graph node's colour class: sealed wins over the file's type."""
    return F.when(status == "sealed", "sealed").when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").otherwise("text")


def titled(documents: DataFrame, query: str, empty_finds_all: bool, statuses: list[str] | None = None) -> DataFrame:
    """documents (title, status) whose title has the trimmed query, whatever the case, and whose status is one of those. An empty query finds all in a list of documents, nothing in a graph."""
    q = query.strip().lower()
    rows = documents if statuses is None else documents.where(F.col("status").isin(statuses))
    return rows.where(F.contains(F.lower("title"), F.lit(q)) if q else F.lit(empty_finds_all))
