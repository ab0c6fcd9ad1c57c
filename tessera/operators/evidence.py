"""Layout generations, evidence behind chunks, sealing: transforms over several tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import variants as V

from tessera.functions import scalars


def activate_generations(tables: dict[str, DataFrame], wanted: DataFrame) -> dict[str, DataFrame]:
    """wanted (generation) become their documents' active ones. tables: documents (document, active, version, layout_status), generations (generation, document, version, state, completeness), chunks (chunk, document, generation, embedding).

    Other generations' chunks lose their vectors; other generations retire, failed ones aside; what is incomplete is partial.
    """
    g = tables["generations"]
    chosen = g.join(wanted.select("generation").distinct(), "generation").select("document", F.col("generation").alias("_on"), F.col("version").alias("_version"), F.col("completeness").alias("_complete"))
    rows = g.join(chosen.select("document", "_on"), "document", "left")
    state = F.when(F.col("_on") == F.col("generation"), F.when(F.col("completeness") < 1, "partial").otherwise("active")).when(F.col("_on").isNotNull() & (F.col("state") != "failed"), "retired").otherwise(F.col("state"))
    chunks = tables["chunks"].join(chosen.select("document", "_on"), "document", "left")
    keeps = F.col("_on").isNull() | F.col("generation").eqNullSafe(F.col("_on"))
    docs = tables["documents"].join(chosen, "document", "left")
    status = F.when(F.col("_complete") < 1, "partial").when(F.col("_complete").isNotNull(), "ready").otherwise(F.col("layout_status"))
    return {
        "documents": docs.select("document", F.coalesce("_on", "active").alias("active"), F.coalesce("_version", "version").alias("version"), status.alias("layout_status")),
        "generations": rows.select("generation", "document", "version", state.alias("state"), "completeness"),
        "chunks": chunks.select("chunk", "document", "generation", F.when(keeps, F.col("embedding")).alias("embedding")),
    }


def complete_enrichment(tables: dict[str, DataFrame], summaries: DataFrame) -> dict[str, DataFrame]:
    """summaries (region, summary) arrive. tables: regions (region, generation, surface, content, summary, source), chunks (region, kind, content), generations (generation, enriched: array, n_complex, completeness, state).

    A region is merged where it had text of its own, else vision; empty visual chunks take the summary; a generation is complete when as many surfaces are enriched as are complex.
    """
    s = summaries.groupBy("region").agg(F.max("summary").alias("_new"))
    regions = tables["regions"].join(s, "region", "left")
    new = F.col("_new").isNotNull()
    source = F.when(new, F.when(F.col("content") == "", "vision").otherwise("merged")).otherwise(F.col("source"))
    seen = regions.where(new).groupBy("generation").agg(F.collect_set("surface").alias("_seen"))
    g = tables["generations"].join(seen, "generation", "left")
    enriched = F.array_sort(F.array_distinct(F.concat("enriched", F.coalesce("_seen", F.array().cast("array<int>")))))
    g = g.withColumn("_all", enriched)
    share = scalars.completeness(F.size("_all"), F.col("n_complex"))
    touched = F.col("_seen").isNotNull()
    chunks = tables["chunks"].join(s, "region", "left")
    filled = F.when(F.col("_new").isNotNull() & (F.col("kind") == "visual") & (F.col("content") == ""), F.col("_new")).otherwise(F.col("content"))
    return {
        "regions": regions.select("region", "generation", "surface", "content", F.coalesce("_new", "summary").alias("summary"), source.alias("source")),
        "chunks": chunks.select("region", "kind", filled.alias("content")),
        "generations": g.select("generation", F.when(touched, F.col("_all")).otherwise(F.col("enriched")).alias("enriched"), "n_complex", F.when(touched, share).otherwise(F.col("completeness")).alias("completeness"), F.when(touched, F.when(share >= 1, "active").otherwise("partial")).otherwise(F.col("state")).alias("state")),
    }


def evidence(asked: DataFrame, chunks: DataFrame, documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(asked columns, status): what each asked chunk's evidence is. chunks: (chunk, document, region); documents: (document, status); tombstones: (chunk).

    A missing chunk with a tombstone is sealed, without one not_found; one of a sealed document is sealed; one without a region legacy.
    """
    gone = tombstones.select("chunk", F.lit(True).alias("_gone")).distinct()
    owner = documents.select("document", F.col("status").alias("_status"))
    rows = asked.join(chunks.select("chunk", "document", "region"), "chunk", "left").join(gone, "chunk", "left").join(owner, "document", "left")
    status = F.when(F.col("_status").isNull(), F.when(F.col("_gone"), "sealed").otherwise("not_found")).when(F.col("_status") == "sealed", "sealed").when(F.col("region").isNull(), "legacy").otherwise("ok")
    return rows.select(*asked.columns, status.alias("status"))


def shown_surface(asked: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(chunk, page, shows_region): the page shown for (chunk, document, own_page, wanted_page): the wanted one if the document has it; the region shows on its own page alone."""
    there = surfaces.select("document", F.col("page").alias("wanted_page"), F.lit(True).alias("_there")).distinct()
    rows = asked.join(there, ["document", "wanted_page"], "left")
    page = F.when(F.col("_there"), F.col("wanted_page")).otherwise(F.col("own_page"))
    return rows.select("chunk", page.alias("page"), (page == F.col("own_page")).alias("shows_region"))


def reindex_decision(status: Column, layout_status: Column) -> Column:
    """not_found for a null status; sealed documents can't be rebuilt; only ready ones that are not building are queued."""
    return F.when(status.isNull(), "not_found").when(status == "sealed", "document_sealed").when((layout_status == "building") | (status != "ready"), "already_queued").otherwise("queued")


def resume_decision(owned: Column, status: Column, state: Column, last_error: Column, path_ok: Column) -> Column:
    """Unfinished or expired uploads go on; a null state is a missing job."""
    unfinished = F.coalesce((state == "uploading") | ((state == "failed") & last_error.eqNullSafe(F.lit("upload_expired"))), F.lit(False))
    return F.when(~owned, "not_found").when(~status.isin("processing", "failed") | ~unfinished | ~path_ok, "upload_not_resumable").otherwise("resumed")


def seal(tables: dict[str, DataFrame], ciphertexts: DataFrame) -> dict[str, DataFrame]:
    """Documents of ciphertexts (document, ordinal, ciphertext, salt, nonce) are sealed if they are ready. tables: documents (document, status), chunks (chunk, document, …), generations (document, …), sealed_chunks, tombstones (chunk, document).

    Their chunks and layout go; a tombstone stays for each chunk. Others are left as they are.
    """
    docs = tables["documents"]
    ready = docs.where("status = 'ready'").join(ciphertexts.select("document").distinct(), "document", "left_semi").select("document")
    marked = docs.join(ready.withColumn("_seal", F.lit(True)), "document", "left")
    gone = tables["chunks"].join(ready, "document", "left_semi").select("chunk", "document")
    return {
        "documents": marked.withColumn("status", F.when(F.col("_seal"), "sealed").otherwise(F.col("status"))).drop("_seal"),
        "chunks": tables["chunks"].join(ready, "document", "left_anti"),
        "generations": tables["generations"].join(ready, "document", "left_anti"),
        "sealed_chunks": tables["sealed_chunks"].unionByName(ciphertexts.join(ready, "document", "left_semi")),
        "tombstones": tables["tombstones"].unionByName(gone).distinct(),
    }


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """Pixels of a box in shares: truncated; the far edges at least 1."""
    at = lambda i, size: (box[i] * size).cast("int")
    one = F.lit(1)
    return F.array(at(0, width), at(1, height), F.greatest(one, at(2, width)), F.greatest(one, at(3, height)))


def visual_budget(chunks: DataFrame, most: int = 4, budget: int = 6 * 1024 * 1024) -> DataFrame:
    """Of ranked chunks (qid, position, region, region_type, n_bytes): those whose picture goes along, each region once, while base64 sizes fit; nothing after the first that doesn't, nor beyond `most`."""
    rows = chunks.where(F.col("region").isNotNull() & F.col("region_type").isin("chart", "image", "table"))
    first = F.row_number().over(Window.partitionBy("qid", "region").orderBy("position"))
    rows = rows.withColumn("_nth", first).where("_nth = 1 AND n_bytes IS NOT NULL").drop("_nth")
    so_far = Window.partitionBy("qid").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    size = 4 * F.floor((F.col("n_bytes") + 2) / 3)
    rows = rows.withColumns({"encoded": size, "_total": F.sum(size).over(so_far), "_count": F.count("*").over(so_far)})
    return rows.where((F.col("_total") <= budget) & (F.col("_count") <= most)).drop("_total", "_count")


def stable_id(*parts: Column | str) -> Column:
    """An id that the same parts always give."""
    return F.sha2(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def layout_rows(regions: DataFrame, version: int) -> dict[str, DataFrame]:
    """Rows to store of a layout's regions (document, surface, ordinal, parent, region_type, content): generations, surfaces, regions.

    A surface keeps its id over all versions of a document's layout; regions have new ones in each. Writing a version twice gives the same rows.
    """
    generation = stable_id("generation", F.col("document"), F.lit(version))
    region = lambda ordinal: stable_id("region", generation, F.col(ordinal))
    surface = stable_id("surface", F.col("document"), F.col("surface"))
    rows = regions.withColumns({"id": region("ordinal"), "generation": generation, "surface_id": surface, "parent_id": F.when(F.col("parent").isNotNull(), region("parent"))})
    return {
        "generations": rows.groupBy("document", "generation").agg(F.lit(version).alias("version"), F.count("*").alias("n_regions")),
        "surfaces": rows.select("document", "surface", F.col("surface_id").alias("id")).distinct(),
        "regions": rows.select("id", "generation", "surface_id", "ordinal", "parent_id", "region_type", "content"),
    }


def checkpointed(generations: DataFrame, done: DataFrame) -> DataFrame:
    """generations (generation, checkpoint: JSON text) after the surfaces of done (generation, surface) were enriched: with completeness and state.

    enriched_surfaces has what it had and the new ones, each once, in order; other keys stay. completeness is their number over that of
    complex_surfaces, at most 1, and 1 without any; a complete generation is active, else partial. A checkpoint that is no object is left, as are generations without new surfaces.
    """
    new = done.where(F.col("surface").isNotNull()).groupBy("generation").agg(F.collect_set(F.col("surface").cast("int")).alias("_new"))
    rows = generations.join(new, "generation").withColumn("_v", V.parsed(F.col("checkpoint")))
    had = F.coalesce(V.elements(V.at(F.col("_v"), "$.enriched_surfaces"), "int"), F.array().cast("array<int>"))
    rows = rows.withColumn("_all", F.array_sort(F.array_distinct(F.array_compact(F.concat(had, "_new")))))
    n = F.coalesce(V.length(V.at(F.col("_v"), "$.complex_surfaces")), F.lit(0))
    rows = rows.withColumn("completeness", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.size("_all") / n)))
    text = F.coalesce(F.to_json(V.with_path(F.col("_v"), ["enriched_surfaces"], V.from_value(F.col("_all")))), "checkpoint")
    return rows.select("generation", text.alias("checkpoint"), "completeness", F.when(F.col("completeness") >= 1, "active").otherwise("partial").alias("state"))
