"""Jobs, limits, boards, todos, sealed content, deletion, evaluation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (requests, seconds) of each class.
LIMITS = {"chat": (20, 60), "upload": (10, 3600), "seal_unseal": (5, 3600), "graph": (60, 60), "general": (100, 60)}


def admit(hits: deque, at: float, limit: int, window: float) -> tuple[bool, float]:
    """One request against the accepted ones of the window: allowed, and the seconds until it would be. Denied requests leave no trace."""
    while hits and at - hits[0] >= window:
        hits.popleft()
    if len(hits) < limit:
        hits.append(at)
        return True, 0.0
    return False, window - (at - hits[0])


def rate_limited(requests: DataFrame, limit: int, window: float, keys: list[str]) -> DataFrame:
    """requests (keys, id, ts) with allowed and retry_after, by a sliding log of accepted requests a key.

    Tasks stream through keys in order and hold one key's log, at most `limit` times.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*keys, "id").schema) + ", allowed boolean, retry_after double"
    rows = requests.select(*keys, "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hits = None, deque()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                key = tuple(r[: len(keys)])
                if key != now:
                    now, hits = key, deque()
                out.append(admit(hits, r.at, limit, window))
            yield b.drop(columns="at").assign(allowed=[x for x, _ in out], retry_after=[round(x, 6) for _, x in out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", "id").mapInPandas(run, schema)


def sweep_uploads(jobs: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Uploads older than an hour fail with upload_expired."""
    late = (F.col("state") == "uploading") & (F.col("created_at") < now - F.make_interval(hours=F.lit(hours)))
    return jobs.withColumns({"last_error": F.when(late, "upload_expired").otherwise(F.col("last_error")), "state": F.when(late, "failed").otherwise(F.col("state"))})


def recoverable(jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Jobs in a working state, untouched for five minutes, whose lease is none or over."""
    working = F.col("state").isin("normalizing", "extracting", "embedding")
    stale = F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes))
    return jobs.where(working & stale & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)))


def retry_stage(state: Column, has_chunks: Column, source: Column) -> Column:
    return F.when(state != "failed", "not_retryable").when(has_chunks, "embedding").when(source == "capture", "extracting").otherwise("normalizing")


def confirm_upload(owned: Column, job_state: Column, status: Column, stored_size: Column, cap: int = 52_428_800) -> Column:
    """The first rule that decides about an upload's confirmation."""
    return (
        F.when(~owned, "not_found")
        .when(job_state.isNull(), "conflict")
        .when(job_state.isin("normalizing", "extracting", "embedding", "ready"), "already_started")
        .when(~((job_state == "uploading") & (status == "processing")), "conflict")
        .when(stored_size.isNull(), "upload_not_found")
        .when(stored_size > cap, "file_too_large")
        .otherwise("started")
    )


def next_positions(cards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position): where the next card of each column goes, 1000 past the last."""
    return cards.groupBy(*keys).agg(F.coalesce(F.max("position") + 1000, F.lit(0.0)).alias("position"))


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the patch's non-null values; a null never clears a field."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(p, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def decrypted(rows: DataFrame, key: Column) -> DataFrame:
    """rows (nonce, ciphertext in base64) with plain; null where the key or the bytes are wrong."""
    raw = F.concat(F.try_to_binary("nonce", F.lit("base64")), F.try_to_binary("ciphertext", F.lit("base64")))
    return rows.withColumn("plain", F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"))


def live_claims(claims: DataFrame, now: Column) -> DataFrame:
    """The latest claim of each document, unless over (at its very end it is)."""
    last = claims.groupBy("document").agg(F.max("expires_at").alias("expires_at"))
    return last.where(F.col("expires_at") > now)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, cascade: list[str], unlink: list[str]) -> dict[str, DataFrame]:
    """Rows of the cascading tables go with their document; in the others its reference becomes null. Tables and gone have `document`."""
    ids = gone.select("document").distinct()
    out = {n: tables[n].join(ids, "document", "left_anti") for n in cascade}
    marked = ids.withColumn("_gone", F.lit(True))
    for n in unlink:
        t = tables[n]
        out[n] = t.join(marked, "document", "left").select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "document" else F.col(c) for c in t.columns])
    return out


def storage_usage(documents: DataFrame, quota: int) -> DataFrame:
    """(user_id, bytes, n_sealed, percent): null sizes count as 0, the percentage stops at 100."""
    used = F.sum(F.coalesce("size", F.lit(0)))
    return documents.groupBy("user_id").agg(used.alias("bytes"), F.count_if(F.col("status") == "sealed").alias("n_sealed"), F.least(F.lit(100.0), F.round(100.0 * used / quota, 6)).alias("percent"))


def evaluation(records: DataFrame) -> DataFrame:
    """Four rates; a missing flag is false, and a rate over no rows 0."""
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rate = lambda c, use: F.coalesce(F.avg(F.when(use, flag(c))), F.lit(0.0))
    visual, every = F.col("expected_region_type").isin("chart", "image", "table"), F.lit(True)
    return records.agg(
        F.round(rate("correct_page", F.col("expected_page").isNotNull()), 6).alias("correct_page_rate"),
        F.round(rate("retrieved_in_top_5", visual), 6).alias("visual_recall_at_5"),
        F.round(rate("citations_resolved", every), 6).alias("citation_resolution_rate"),
        F.round(rate("answer_correct", every), 6).alias("answerable_accuracy"),
    )


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A change log's current rows: the last version of each key wins."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))
    return log.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def embed_outcomes(chunks: DataFrame, jobs: DataFrame, providers: list[str]) -> DataFrame:
    """(document, checkpoint, state, last_error, n_new) after each job's run. jobs: (document, provider, checkpoint); chunks: (document, ordinal, error).

    Chunks up to the checkpoint are done already; the first error stops the job there, and a later run goes on from its checkpoint.
    """
    left = chunks.join(jobs.select("document", "checkpoint"), "document").where(F.col("ordinal") > F.col("checkpoint"))
    stop = left.groupBy("document").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("ordinal", "error"))).alias("stop"))
    done = left.join(stop, "document").where(F.col("stop").isNull() | (F.col("ordinal") < F.col("stop.ordinal"))).groupBy("document").agg(F.max("ordinal").alias("last"), F.count("*").alias("n"))
    rows = jobs.join(stop, "document", "left").join(done, "document", "left")
    known = F.col("provider").isin(providers) if providers else F.lit(False)
    error = F.when(~known, "provider_not_configured").otherwise(F.col("stop.error"))
    return rows.select("document", F.when(known, F.coalesce("last", "checkpoint")).otherwise(F.col("checkpoint")).alias("checkpoint"), F.when(error.isNull(), "ready").otherwise("failed").alias("state"), error.alias("last_error"), F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_new"))


def agent_cards(asked: DataFrame, boards: DataFrame) -> DataFrame:
    """(id, board, column, title): cards that an agent asked for (id, board, column, title): none on a board that is not the user's; a column that the board lacks becomes its first. boards: (board, columns: array)."""
    rows = asked.join(boards.select("board", "columns"), "board").where(F.size("columns") > 0)
    return rows.select("id", "board", F.when(F.array_contains("columns", F.coalesce("column", F.lit(""))), F.col("column")).otherwise(F.col("columns")[0]).alias("column"), "title")


def opened(claims: DataFrame, asked: DataFrame, sealed: DataFrame, now: Column) -> DataFrame:
    """(claim, ordinal, ciphertext): sealed chunks that live claims open; asked: (claim, document). A claim opens its own document alone, and at its very end nothing."""
    live = claims.where(F.col("expires_at") > now).select("claim", "document")
    return asked.join(live, ["claim", "document"]).join(sealed, "document").select("claim", "ordinal", "ciphertext")


def changes(snapshots: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Snapshots that differ from the one before; the first always counts."""
    w = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*columns)
    return snapshots.withColumns({"_nth": F.row_number().over(w), "_last": F.lag(state).over(w)}).where((F.col("_nth") == 1) | ~state.eqNullSafe(F.col("_last"))).drop("_nth", "_last")


def dimmed(nodes: DataFrame, query: str, selected: Column) -> DataFrame:
    """nodes (id, title) with `dim`: a search is on, and neither is the node selected nor has its title the words."""
    q = query.strip().lower()
    return nodes.withColumn("dim", F.lit(bool(q)) & ~F.coalesce(selected, F.lit(False)) & ~F.contains(F.lower("title"), F.lit(q)))


def needs_recluster(placements: DataFrame, limit: int = 10) -> DataFrame:
    """(user_id, n, recluster): incremental placements since the last clustering; the next one past the limit clusters anew. placements: (user_id, method)."""
    n = F.count_if(F.col("method") == "incremental")
    return placements.groupBy("user_id").agg(n.alias("n"), (n + 1 >= limit).alias("recluster"))
