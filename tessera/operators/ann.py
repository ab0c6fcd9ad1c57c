"""Approximate nearest vectors by cosine: an inverted file of cells with product-quantised residuals, re-ranked by exact distances.

Centres of cells, codebooks and the number of cells to meet are learned from a bounded sample; every vector is indexed, as its cell and one byte a few dimensions. A
search meets each question with the codes of its nearest cells only, keeps the `short` best by the codes' distances, and looks the vectors of
those up once. Vectors that gather in places are found in few cells; for ones that do not, nearly all cells are met, by their codes. Blocks of QUERY_BLOCK questions
meet chunks of CHUNK_ROWS codes of all cells, so a question is sent once a chunk, a code once a block, and `short` rows a question and chunk come back. The vectors are never copied for questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.joins import small
from tessera.functions.vectors import matrix
from tessera.operators.retrieval import QUERY_BLOCK, Best
from tessera.sources.scratch import stash

CHUNK_ROWS = 1 << 17  # codes that one task streams for a block of questions, about


@dataclass(frozen=True)
class Settings:
    """sample_rows and sample_bytes bound what is learned from; cells: at most, else about the root of the rows; dims: a byte's; found: the share of nearest vectors that should lie in the cells that a question meets, whose number is calibrated for that on the sample; short: candidates that are re-ranked."""

    sample_rows: int = 1 << 16
    sample_bytes: int = 64 << 20
    cells: int = 4096
    dims: int = 4
    found: float = 0.985
    short: int = 200
    rounds: int = 12
    seed: int = 11


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T)


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of a sample."""
    out = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _squares(x, out).argmin(1)
        n = np.bincount(at, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, at, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def _split(x: np.ndarray, dims: int) -> list[np.ndarray]:
    return [x[:, i : i + dims] for i in range(0, x.shape[1], dims)]


def _probes(x: np.ndarray, centres: np.ndarray, found: float, k: int = 20, asked: int = 256) -> int:
    """How many cells hold a share `found` of the k nearest of a sample's first rows among the others."""
    q = x[:asked]
    d = _squares(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, axis=1)[:, : max(1, min(k, len(x) - 1))]
    order = _squares(q, centres).argsort(1).argsort(1)  # each cell's place among a row's cells
    at = np.sort(np.take_along_axis(order, _squares(x, centres).argmin(1)[near], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(found * len(at))))]) + 1


@dataclass
class Model:
    """centres: (cells, dimensions); books: for each few dimensions, up to 256 parts of residuals; probes: cells that a question meets."""

    centres: np.ndarray
    books: list[np.ndarray]
    dims: int
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector, and its code."""
        cell = _squares(x, self.centres).argmin(1)
        parts = _split(x - self.centres[cell], self.dims)
        return cell, np.stack([_squares(p, b).argmin(1).astype(np.uint8) for p, b in zip(parts, self.books, strict=True)], 1)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.centres[cell] + np.hstack([b[c] for b, c in zip(self.books, codes.T, strict=True)])

    def met(self, q: np.ndarray) -> np.ndarray:
        """(questions, cells): whether a question meets a cell."""
        d = _squares(q, self.centres)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes], True, axis=1)
        return out


def _encoded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            cell, codes = model.encode(_unit(matrix(b.column(1))))
            raw, width = codes.tobytes(), codes.shape[1]
            held = [raw[i * width : (i + 1) * width] for i in range(len(codes))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(held, pa.binary())], names=["id", "cell", "code"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in filter(len, batches):
        held = [x.tobytes() for x in _unit(matrix(b.column(1))).astype("<f4")]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["id", "payload"])


def _by_codes(model: Model, short: int):
    """Rows (chunk, block, side, cell, id, payload) sorted by the first four: of each chunk and block the questions come first and are held, the codes stream by, cell by cell. A question keeps its `short` best over all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, met, asked = None, None, None, []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (group := tuple(keys[:2, lo])) != now:
                    if best is not None:
                        yield best.batch()
                    now, best, met, asked = group, None, None, []
                ids, raw = b.column(4).slice(lo, hi - lo).to_numpy(), b"".join(b.column(5).slice(lo, hi - lo).to_pylist())
                if keys[2, lo] == 0:
                    asked.append((ids, np.frombuffer(raw, "<f4").reshape(hi - lo, -1).astype(np.float64)))
                    continue
                if best is None and asked:
                    best = Best(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), short, "cosine")
                    met = model.met(best.q)
                cells, codes = b.column(3).slice(lo, hi - lo).to_numpy(), np.frombuffer(raw, np.uint8).reshape(hi - lo, -1)
                for at in range(0, len(ids) if best is not None else 0, 2048):
                    part = slice(at, at + 2048)
                    meets = met[:, cells[part]]
                    own = np.flatnonzero(meets.any(1))
                    d = np.full(meets.shape, np.inf)
                    d[own] = np.where(meets[own], _squares(best.q[own], model.decode(cells[part], codes[part])), np.inf)
                    best.keep(ids[part], d, meets)
        if best is not None:
            yield best.batch()

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in filter(len, batches):
        d = 1 - (_unit(matrix(b.column(2))) * _unit(matrix(b.column(3)))).sum(1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(d, 9))], names=["qid", "id", "distance"])


@dataclass
class VectorIndex:
    """codes: a stored table (id, cell, code)."""

    codes: DataFrame | None
    model: Model | None
    settings: Settings

    def search(self, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, distance, rank): nearly always the k nearest of corpus (id, embedding) for each of queries (qid, embedding); distances are exact, ties go to the least id. Null vectors find nothing and are not found."""
        s, spark = self.settings, corpus.sparkSession
        if self.model is None:
            return spark.createDataFrame([], "qid long, id long, distance double, rank int")
        held = stash(queries.where(F.col("embedding").isNotNull()).select(F.col("qid").cast("long").alias("qid"), "embedding"), "questions")
        n, blocks = self.codes.count(), max(1, -(-held.count() // QUERY_BLOCK))
        chunks = max(1, -(-n // CHUNK_ROWS), min(n // 4096, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
        own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = held.select(F.col("qid").alias("id"), "embedding").mapInArrow(_asked, "id long, payload binary")
        left = asked.select(every(chunks).alias("chunk"), own(blocks).alias("block"), F.lit(0).alias("side"), F.lit(-1).alias("cell"), "id", "payload")
        right = self.codes.select(own(chunks).alias("chunk"), every(blocks).alias("block"), F.lit(1).alias("side"), "cell", "id", F.col("code").alias("payload"))
        grid = left.unionByName(right).repartition(chunks * blocks, "chunk", "block").sortWithinPartitions("chunk", "block", "side", "cell")
        near = grid.mapInArrow(_by_codes(self.model, max(s.short, k)), "qid long, id long, distance double")
        nth = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        near = stash(near.withColumn("nth", nth).where(F.col("nth") <= max(s.short, k)).select("qid", "id"), "short")
        vectors = corpus.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
        pairs = vectors.join(small(near), "id").join(small(held.withColumnRenamed("embedding", "asked")), "qid").select("qid", "id", "embedding", "asked")
        out = pairs.mapInArrow(_exact, "qid long, id long, distance double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)


def build_index(corpus: DataFrame, path: str, settings: Settings = Settings()) -> VectorIndex:  # noqa: B008
    """Learn cells and codebooks from the rows of corpus (id, embedding) with the least hashed ids, and store all rows' codes under path, by cell."""
    s, spark = settings, corpus.sparkSession
    rows = corpus.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    one = rows.select(F.size("embedding").alias("n")).first()
    if one is None:
        return VectorIndex(None, None, s)
    most = max(1, min(s.sample_rows, s.sample_bytes // (8 * one["n"])))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()  # at most sample_rows rows, sample_bytes bytes
    x, rng = _unit(np.stack(drawn["embedding"]).astype(np.float64)), np.random.default_rng(s.seed)
    cells = max(1, min(s.cells, len(x) // 8 or 1, round(rows.count() ** 0.5)))
    centres = _centres(x, cells, s.rounds, rng)
    rest = x - centres[_squares(x, centres).argmin(1)]
    model = Model(centres, [_centres(p, min(256, len(p)), s.rounds, rng) for p in _split(rest, s.dims)], s.dims, _probes(x, centres, s.found))
    rows.mapInArrow(_encoded(model), "id long, cell int, code binary").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/codes")
    parts = [(-1, i, b.tolist()) for i, b in enumerate(model.books)] + [(0, model.probes, centres.tolist())]
    spark.createDataFrame(parts, "kind int, nth int, rows array<array<double>>").write.parquet(f"{path}/model")
    return open_index(spark, path, s)


def open_index(spark: SparkSession, path: str, settings: Settings = Settings()) -> VectorIndex:  # noqa: B008
    """The index that build_index() stored under path, with the same settings."""
    parts = sorted(spark.read.parquet(f"{path}/model").collect())  # cells and books: bounded by the settings
    books = [np.array(p["rows"]) for p in parts if p["kind"] == -1]
    return VectorIndex(spark.read.parquet(f"{path}/codes"), Model(np.array(parts[-1]["rows"]), books, settings.dims, parts[-1]["nth"]), settings)
