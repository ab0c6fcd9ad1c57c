"""Tables of a vault. Every read of a user's rows goes through Vault, which always applies the tenant's filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("processing", "ready", "failed", "sealed")
PROVIDERS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_status(doc_id: Column) -> Column:
    """The adapter's rule for tables that have no status."""
    return F.when(doc_id % 17 == 0, "sealed").when(doc_id % 13 == 0, "processing").otherwise("ready")


class Vault:
    """One tenant's view of the tables (all tenants' with user_id None, for batch jobs over the whole vault)."""

    def __init__(self, spark: SparkSession, sf_dir: str, user_id: str | None = None):
        self.spark, self.sf_dir, self.user_id = spark, sf_dir, user_id

    def _own(self, df: DataFrame) -> DataFrame:
        return df if self.user_id is None else df.where(F.col("user_id") == self.user_id)

    def documents(self) -> DataFrame:
        """id, user_id, text, lang, size, status, provider."""
        d = table(self.spark, self.sf_dir, "documents")
        d = d.select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), "text", "lang", F.col("n_chars").alias("size"), document_status(F.col("doc_id")).alias("status"), F.concat(F.lit("p"), (F.col("doc_id") % PROVIDERS).cast("string")).alias("provider"))
        return self._own(d)

    def searchable(self) -> DataFrame:
        """Documents that retrieval may see: never sealed ones."""
        return self.documents().where(F.col("status") == "ready")

    def vectors(self) -> DataFrame:
        """id (of chunk and document), label, embedding; only of documents that retrieval may see."""
        return self._vectors().join(self.searchable().select("id"), "id", "left_semi")

    def all_vectors(self) -> DataFrame:
        """vectors(), also of documents that are sealed or not ready, for jobs that move or delete them."""
        rows = self._vectors()
        return rows if self.user_id is None else rows.join(self.documents().select("id"), "id", "left_semi")

    def _vectors(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")

    def messages(self) -> DataFrame:
        """session, turn, role, content; a session is its user's."""
        rows = table(self.spark, self.sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"))
        owner = F.concat(F.lit("src"), (F.col("session") % 20).cast("string"))  # the adapter's rule, as the table names no user
        return rows if self.user_id is None else rows.where(owner == self.user_id)


#: The same adapter for DuckDB.
DOCS_SQL = """(SELECT doc_id AS id, source AS user_id, text, lang, n_chars AS size,
  CASE WHEN doc_id % 17 = 0 THEN 'sealed' WHEN doc_id % 13 = 0 THEN 'processing' ELSE 'ready' END AS status,
  'p' || (doc_id % 3) AS provider FROM documents)"""


#: Vectors that retrieval may see.
VECTORS_SQL = f"(SELECT e.* FROM embeddings e SEMI JOIN {DOCS_SQL} x ON x.id = e.vec_id AND x.status = 'ready')"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files, a row each: path, source; bytes that are no UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
