"""Clusters, nearest neighbours and co-retrieval links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.joins import fits, small
from tessera.functions.vectors import matrix
from tessera.sources.scratch import stash

EXPLICIT_WEIGHT, RENDER_FLOOR, RECLUSTER_AT = 5.0, 1.5, 10
PAIR_BLOCK = 1000  # chunks of a turn on one side of a block of pairs, about
TASK_ROWS = 1_000_000  # rows, or pairs, that a task sums up at once, about


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the mean of each group's vectors, in double; tasks add up what they have of a group before it is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = rows.where(F.col("embedding").isNotNull()).select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return parts.groupBy(key).agg(Summarizer.mean(F.col("v")).alias("v")).select(key, vector_to_array("v").alias("embedding"))


def _assign(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = matrix(batch.column(1))
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T))
    at = np.round(d, 9).argmin(1)  # the first of equals
    return x, at, d[np.arange(len(x)), at]


def _lloyd(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in filter(len, batches):
            x, at, _ = _assign(b, centres)
            np.add.at(sums, at, x)
            n += np.bincount(at, minlength=len(centres))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.arange(len(n)), pa.int32()), "n": pa.array(n), "total": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    return run


def _labels(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            _, at, d = _assign(b, centres)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def draw_number(step: Column, seed: int = 0) -> Column:
    """A number in (0, 1) of each id for a step of a seeded draw: 48 bits of a digest, so it is the same wherever the row is read."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), step, F.col("id").cast("string"))), 1, 12), 16, 10)
    return (bits.cast("double") + 1) / F.lit(float(2**48 + 1))


def _far(ids: np.ndarray, centres: np.ndarray, most: int):
    """Of a task's rows (id, embedding, u) the `most` least keys -ln(u) / d, d the squared distance to the nearest centre: a draw weighted by d. Drawn ids do not come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in filter(len, batches):
            keys = -np.log(b.column(2).to_numpy(zero_copy_only=False))
            if len(centres):
                x = matrix(b.column(1))
                own = (x * x).sum(1)
                d = np.maximum(0, own[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T).min(1)
                with np.errstate(divide="ignore"):
                    keys = np.where(d > 1e-12 * np.maximum(own, 1e-300), keys / d, np.inf)  # at a centre: last, by id
            rows = b.select([0, 1]).append_column("key", pa.array(keys)).filter(pa.array(~np.isin(b.column(0).to_numpy(), ids)))
            rows = pa.Table.from_batches([rows] if best is None else [*best.to_batches(), rows])
            best = rows.sort_by([("key", "ascending"), (rows.column_names[0], "ascending")]).slice(0, most).combine_chunks()
        if best is not None:
            yield from best.rename_columns(["id", "embedding", "key"]).to_batches()

    return run


def seeds(rows: DataFrame, k: int, rounds: int = 0, seed: int = 0) -> np.ndarray:
    """k-means++ centres (fewer where there are fewer rows with a vector), the same draw at any partitioning.

    Each is drawn with a chance by its squared distance to the nearest one drawn before, as the row of least -ln(u) / d. rounds 0: one
    pass over the rows a centre. Otherwise the parallel form: so many passes draw k rows each, every row counts for the nearest drawn
    one, and k of those are drawn on the driver by count and distance. The driver holds k (rounds + 1) vectors at most. Where all that
    is left lies at a centre, the least ids follow.
    """
    held = rows.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    kind = held.schema["embedding"].dataType.simpleString()
    ids, centres = np.zeros(0, np.int64), np.zeros((0, 0))

    def draw(step: int, most: int) -> bool:
        nonlocal ids, centres
        far = held.withColumn("u", draw_number(F.lit(str(step)), seed)).mapInArrow(_far(ids, centres, most), f"id long, embedding {kind}, key double")
        got = far.orderBy("key", "id").limit(most).toPandas()
        if len(got):
            new = np.stack(got["embedding"]).astype(np.float64)
            ids, centres = np.append(ids, got["id"].to_numpy(np.int64)), np.concatenate([centres, new]) if len(centres) else new
        return len(got) == most

    more = draw(0, 1)
    for step in range(1, rounds + 1 if rounds else k):
        if not more:
            break
        more = draw(step, k if rounds else 1)
    if not rounds or len(ids) <= k:
        return centres[:k]
    n = held.mapInArrow(_labels(centres), "id long, cluster int, distance double").groupBy("cluster").count().toPandas()  # a row a drawn vector
    weight = np.zeros(len(ids))
    weight[n["cluster"].to_numpy()] = n["count"].to_numpy()
    rng, chosen = np.random.default_rng(seed), []
    least = np.ones(len(ids))
    for _ in range(k):
        share = weight * least
        with np.errstate(divide="ignore"):
            key = np.where(share > 0, rng.exponential(size=len(ids)) / share, np.inf)
        key[chosen] = np.nan
        chosen.append(int(np.nanargmin(key)))
        d = np.maximum(0, ((centres - centres[chosen[-1]]) ** 2).sum(1))
        least = d if len(chosen) == 1 else np.minimum(least, d)
    return centres[chosen]


def kmeans(rows: DataFrame, k: int, iterations: int = 100, start: np.ndarray | None = None) -> DataFrame:
    """(id, cluster, distance) by Lloyd's steps from start (see seeds()), or else from the k least ids; an empty cluster keeps its centre; stops when nothing moves.

    Tasks send one sum a cluster; the driver holds the k centres, and gets one row a cluster in each step.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    held = rows.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    if start is None:
        first = held.orderBy("id").limit(k).toPandas()["embedding"]
        start = np.stack(first) if len(first) else np.zeros((0, 0))
    if not len(start):
        return held.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    centres = np.asarray(start, np.float64)
    for _ in range(iterations):
        parts = held.mapInArrow(_lloyd(centres), "cluster int, n long, total array<double>").where("n > 0").select("cluster", "n", array_to_vector("total").alias("total"))
        new = centres.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("total")).alias("total")).select("cluster", "n", vector_to_array("total").alias("total")).collect():
            new[r["cluster"]] = np.array(r["total"]) / r["n"]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return held.mapInArrow(_labels(centres), "id long, cluster int, distance double")


def ancestors(nodes: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(node, path, looped): of nodes (node, parent) each one's ancestors, root first, whatever the depth.

    Paths double in length each round, so a chain of n takes log2(n) joins. A parent that is no node ends a path and is not in it.
    Nodes on a cycle of parents, or below one, get the path up to the first node that comes again, and looped. No chain may be longer than
    `most`. A node of several rows has the least parent; null nodes are left out.
    """
    own = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    known = own.select(F.col("node").alias("parent"))
    rows = own.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), F.array("parent").alias("path"))
    none = F.array().cast(rows.schema["path"].dataType)
    rows = rows.unionByName(own.join(known, "parent", "left_anti").select("node", F.lit(None).cast(own.schema["node"].dataType).alias("up"), none.alias("path")))
    rows = stash(rows.withColumn("looped", F.lit(False)), "ancestors")
    reach = 1
    while reach < most and not rows.where(F.col("up").isNotNull()).isEmpty():
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("looped").alias("_looped"))
        whole = F.concat("_path", "path")
        rows = rows.join(above, "up", "left").select("node", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(whole).alias("path"), (F.col("looped") | F.coalesce("_looped", F.lit(False))).alias("looped"))
        again = F.size(F.array_distinct(F.concat(F.array("node"), F.reverse("path")))) <= F.size("path")
        rows = stash(rows.select("node", F.when(~again & ~F.col("looped"), F.col("up")).alias("up"), "path", (again | F.col("looped")).alias("looped")), "ancestors")
        reach *= 2
    # upwards from the node, nodes come in the order of their first mention, so a looped path ends where its distinct ones do
    return rows.select("node", F.when(F.col("looped"), F.reverse(F.array_except(F.reverse("path"), F.array("node")))).otherwise(F.col("path")).alias("path"), "looped")


def place(documents: DataFrame, centres: DataFrame, clustered: bool = True) -> DataFrame:
    """Incremental placement: documents (id, embedding) at the nearest centre (cluster, embedding); the first of equals; `unclustered` (null) without centres."""
    found = centres.orderBy("cluster").toPandas()  # k rows
    held = documents.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    if not len(found):
        return held.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    names = found["cluster"].to_numpy(np.int64)
    placed = held.mapInArrow(_labels(np.stack(found["embedding"]).astype(np.float64)), "id long, cluster int, distance double")
    table = F.array(*[F.lit(int(x)) for x in names])
    return placed.withColumn("cluster", F.element_at(table, F.col("cluster") + 1))


def project_3d(rows: DataFrame) -> DataFrame:
    """(id, x, y, z): principal components of the vectors (signs are arbitrary)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    v = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    found = PCA(k=3, inputCol="c", outputCol="p").fit(v).transform(v)
    return found.select("id", *[vector_to_array(F.col("p"))[i].alias(n) for i, n in enumerate("xyz")])


def tasks_for(rows: DataFrame, n: int) -> int:
    """How many tasks n rows are summed up in: as many as run at once, or more, so that none has more than about TASK_ROWS."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))


def co_retrieval(retrieved: DataFrame) -> DataFrame:
    """(a, b, weight, turns, last): pairs of chunks that a turn retrieved together; retrieved: (turn, chunk, ts).

    Chunks meet in blocks of about PAIR_BLOCK by PAIR_BLOCK, one for nearly every turn; a turn with more is a grid of them, over as many tasks.
    Hardly a row or pair comes twice within a task, so what a task holds is as large as its share: both are counted, and dealt over tasks of TASK_ROWS
    wherever they meet. Pairs are summed up by twice as many tasks, since a sum holds its pairs twice.
    """
    held = stash(retrieved.select("turn", "chunk", "ts"), "retrieved")
    dealt = tasks_for(held, held.count())
    rows = stash(held.repartition(dealt, "turn", "chunk").groupBy("turn", "chunk").agg(F.max("ts").alias("ts")), "retrieved").repartition(dealt, "turn")
    turns = stash(rows.groupBy("turn").agg(F.max("ts").alias("ts"), F.count("*").alias("n")), "turns")
    n = turns.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0]
    tasks = tasks_for(rows, int(n or 0))
    turns = turns.select("turn", "ts", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")).repartition(dealt, "turn")
    rows = rows.select("turn", "chunk").join(turns, "turn").withColumn("own", F.pmod(F.xxhash64("chunk"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("turn", F.col("own").alias("i"), every.alias("j"), "ts", F.col("chunk").alias("a")).repartition(tasks, "turn", "i", "j")
    right = rows.select("turn", every.alias("i"), F.col("own").alias("j"), F.col("chunk").alias("b")).repartition(tasks, "turn", "i", "j")
    pairs = left.join(right, ["turn", "i", "j"]).where("a < b").select("a", "b", "ts").repartition(2 * tasks, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"), F.count("*").alias("turns"), F.max("ts").alias("last"))


def link_explicitly(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Explicit links (a, b) over edges: weight 5, count 0, overwriting what co-retrieval had; edges are made once."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().withColumn("explicit", F.lit(True))
    made = lambda value, name: F.when(F.col("explicit"), F.lit(value)).otherwise(F.col(name)).alias(name)
    return edges.join(links, ["a", "b"], "full").select("a", "b", made(EXPLICIT_WEIGHT, "weight"), made(0, "turns"), "last", F.coalesce("explicit", F.lit(False)).alias("explicit"))


def effective(edges: DataFrame, now: Column, half_life_hours: float = scalars.HALF_LIFE_HOURS) -> DataFrame:
    return edges.withColumn("effective", scalars.decayed(F.col("weight"), F.col("explicit"), F.col("last"), now, half_life_hours))


def document_links(edges: DataFrame, owner: DataFrame, floor: float = RENDER_FLOOR) -> DataFrame:
    """(document_a, document_b, weight, explicit): effective weights added up by pairs of documents, from the floor on. owner: (chunk, document).

    Where the owners are too many to be sent to every task, edges are stored, counted, and dealt by their ends over tasks of TASK_ROWS.
    """
    known, tasks = fits(owner), 0
    edges = edges.select("a", "b", "effective", "explicit")
    if not known:
        edges = stash(edges, "edges")
        tasks = tasks_for(edges, edges.count())
    dealt = lambda rows, x: rows.repartition(tasks, x) if tasks else rows
    of = lambda x: dealt(small(owner.select(F.col("chunk").alias(x), F.col("document").alias(f"d{x}")), known), x)
    both = dealt(dealt(edges, "a").join(of("a"), "a"), "b").join(of("b"), "b").where("da <> db")
    total = both.groupBy(F.least("da", "db").alias("document_a"), F.greatest("da", "db").alias("document_b")).agg(F.sum("effective").alias("weight"), F.bool_or("explicit").alias("explicit"))
    return total.where(F.col("weight") >= floor)


def touching(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with either end among chunks (chunk), each once; edges are made once for both ends."""
    ends = chunks.select("chunk").distinct()
    of = lambda x: small(ends.select(F.col("chunk").alias(x), F.lit(True).alias(f"_{x}")), known)
    known = fits(ends)
    return edges.join(of("a"), "a", "left").join(of("b"), "b", "left").where("_a OR _b").select(*edges.columns)


def brightness(edges: DataFrame) -> DataFrame:
    """1 for explicit links, else the weight's share of the greatest (at least 1)."""
    top = edges.agg(F.greatest(F.lit(1.0), F.max("effective")).alias("top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("brightness", F.when(F.col("explicit"), 1.0).otherwise(F.least(F.lit(1.0), F.col("effective") / F.col("top")))).drop("top")  # one row


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of rows with equal keys the last in order stays."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
