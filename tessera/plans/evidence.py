"""Queries on generations, evidence, sealing and uploads. Documents' states come from the adapter; generations are ids 2 d and 2 d + 1 of document d."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import variants as V
from tessera.operators import evidence as E
from tessera.plans.registry import query
from tessera.sources import sinks
from tessera.sources.vault import DOCS_SQL, Vault, table

_GENS = f"""d AS (SELECT id FROM {DOCS_SQL}), g AS (SELECT 2 * id + k AS generation, id AS document, k + 1 AS version, CASE WHEN id % 5 = 0 AND k = 0 THEN 'failed' WHEN k = 0 THEN 'active' ELSE 'building' END AS state,
CASE WHEN id % 4 = 0 AND k = 1 THEN 0.5 ELSE 1.0 END AS completeness FROM d, (VALUES (0), (1)) t(k)), on_ AS (SELECT * FROM g WHERE version = 2 AND document % 3 = 0)"""


def _layout(spark, d):
    ids = Vault(spark, d).documents().select(F.col("id").alias("document"))
    gens = ids.select("document", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    i, k = F.col("document"), F.col("k")
    gens = gens.select((2 * i + k).alias("generation"), "document", (k + 1).alias("version"), F.when((i % 5 == 0) & (k == 0), "failed").when(k == 0, "active").otherwise("building").alias("state"), F.when((i % 4 == 0) & (k == 1), 0.5).otherwise(1.0).alias("completeness"))
    docs = ids.select("document", (2 * i).alias("active"), F.lit(1).alias("version"), F.lit("ready").alias("layout_status"))
    v = Vault(spark, d).all_vectors().join(ids, F.col("id") == F.col("document")).select(F.col("id").alias("chunk"), "document", F.when(F.col("id") % 7 > 0, 2 * F.col("id") + F.col("id") % 2).alias("generation"), "embedding")
    return {"documents": docs, "generations": gens, "chunks": v}


@query(
    f"""WITH {_GENS} SELECT 'generation' AS kind, generation AS id, CASE WHEN generation IN (SELECT generation FROM on_) THEN CASE WHEN completeness < 1 THEN 'partial' ELSE 'active' END WHEN document IN (SELECT document FROM on_) AND state <> 'failed' THEN 'retired' ELSE state END AS state FROM g
UNION ALL SELECT 'document', d.id, coalesce(on_.generation, 2 * d.id) || ' ' || coalesce(on_.version, 1) || ' ' || CASE WHEN on_.completeness < 1 THEN 'partial' ELSE 'ready' END FROM d LEFT JOIN on_ ON on_.document = d.id
UNION ALL SELECT 'chunk', e.vec_id, CASE WHEN on_.document IS NULL OR (e.vec_id % 7 > 0 AND 2 * e.vec_id + e.vec_id % 2 = on_.generation) THEN 'kept' ELSE 'cleared' END FROM embeddings e JOIN d ON d.id = e.vec_id LEFT JOIN on_ ON on_.document = e.vec_id"""
)
def activate_generations(spark, d):
    tables = _layout(spark, d)
    out = E.activate_generations(tables, tables["generations"].where("version = 2 AND document % 3 = 0").select("generation"))
    docs = out["documents"].select(F.lit("document").alias("kind"), F.col("document").alias("id"), F.concat_ws(" ", F.col("active").cast("string"), F.col("version").cast("string"), "layout_status").alias("state"))
    chunks = out["chunks"].select(F.lit("chunk").alias("kind"), F.col("chunk").alias("id"), F.when(F.col("embedding").isNull(), "cleared").otherwise("kept").alias("state"))
    return out["generations"].select(F.lit("generation").alias("kind"), F.col("generation").alias("id"), "state").unionByName(docs).unionByName(chunks)


@query(
    """WITH r AS (SELECT event_id AS region, user_id AS generation, (event_id % 4)::INT AS surface, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS content, event_type = 'view' AS new FROM events),
s AS (SELECT generation, list_sort(list(DISTINCT surface) FILTER (WHERE new)) AS seen FROM r GROUP BY generation)
SELECT 'region' AS kind, region AS id, CASE WHEN NOT new THEN 'local' WHEN content = '' THEN 'vision' ELSE 'merged' END AS state FROM r
UNION ALL SELECT 'generation', generation, CASE WHEN seen IS NULL THEN 'untouched 1' ELSE CASE WHEN len(list_distinct(list_concat([1], seen))) >= 3 THEN 'active ' ELSE 'partial ' END || len(list_distinct(list_concat([1], seen))) END FROM s
UNION ALL SELECT 'chunk', region, CASE WHEN new AND region % 2 = 0 AND content = '' THEN 'summary of ' || region ELSE content END FROM r"""
)
def complete_enrichment(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    content = F.when(i % 3 == 0, "").otherwise(F.col("event_type"))
    regions = e.select(i.alias("region"), F.col("user_id").alias("generation"), (i % 4).cast("int").alias("surface"), content.alias("content"), F.lit(None).cast("string").alias("summary"), F.lit("local").alias("source"))
    chunks = e.select(i.alias("region"), F.when(i % 2 == 0, "visual").otherwise("text").alias("kind"), content.alias("content"))
    gens = e.select(F.col("user_id").alias("generation")).distinct().select("generation", F.array(F.lit(1)).alias("enriched"), F.lit(3).alias("n_complex"), F.lit(0.0).alias("completeness"), F.lit("untouched").alias("state"))
    new = e.where("event_type = 'view'").select(i.alias("region"), F.concat(F.lit("summary of "), i.cast("string")).alias("summary"))
    out = E.complete_enrichment({"regions": regions, "chunks": chunks, "generations": gens}, new)
    states = out["generations"].select(F.lit("generation").alias("kind"), F.col("generation").alias("id"), F.concat_ws(" ", "state", F.size("enriched").cast("string")).alias("state"))
    return out["regions"].select(F.lit("region").alias("kind"), F.col("region").alias("id"), F.col("source").alias("state")).unionByName(states).unionByName(out["chunks"].select(F.lit("chunk").alias("kind"), F.col("region").alias("id"), F.col("content").alias("state")))


@query(
    f"""SELECT i.chunk, CASE WHEN d.id IS NULL OR i.chunk % 11 = 4 THEN CASE WHEN i.chunk % 2 = 0 THEN 'sealed' ELSE 'not_found' END WHEN d.status = 'sealed' THEN 'sealed' WHEN i.chunk % 3 = 0 THEN 'legacy' ELSE 'ok' END AS status
FROM (SELECT vec_id AS chunk FROM embeddings) i LEFT JOIN {DOCS_SQL} d ON d.id = i.chunk"""
)
def evidence_status(spark, d):
    ids = Vault(spark, d).all_vectors().select(F.col("id").alias("chunk"))
    docs = Vault(spark, d).documents().select(F.col("id").alias("document"), "status")
    chunks = docs.where("document % 11 <> 4").select(F.col("document").alias("chunk"), "document", F.when(F.col("document") % 3 > 0, F.col("document")).alias("region"))
    return E.evidence(ids, chunks, docs, ids.where("chunk % 2 = 0"))


@query("SELECT page_id AS chunk, CASE WHEN page_id % 4 IN (1, 2) THEN page_id % 4 ELSE 7 END AS page, page_id % 4 NOT IN (1, 2) AS shows_region FROM pages")
def shown_surface(spark, d):
    p = F.col("page_id")
    asked = table(spark, d, "pages").select(p.alias("chunk"), p.alias("document"), F.lit(7).cast("long").alias("own_page"), (p % 4).alias("wanted_page"))
    surfaces = table(spark, d, "pages").select(p.alias("document"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 2, 7)])).alias("page"))
    return E.shown_surface(asked, surfaces)


@query(f"SELECT id, CASE WHEN status = 'sealed' THEN 'document_sealed' WHEN id % 4 = 1 OR status <> 'ready' THEN 'already_queued' ELSE 'queued' END AS decision FROM {DOCS_SQL}")
def reindex_queue(spark, d):
    return Vault(spark, d).documents().select("id", E.reindex_decision(F.col("status"), F.when(F.col("id") % 4 == 1, "building").otherwise("ready")).alias("decision"))


@query(
    """SELECT id, CASE WHEN k = 6 THEN 'not_found' WHEN k = 5 OR NOT coalesce(state = 'uploading' OR (state = 'failed' AND e = 'upload_expired'), false) OR k = 4 THEN 'upload_not_resumable' ELSE 'resumed' END AS decision
FROM (SELECT event_id AS id, event_id % 7 AS k, CASE event_type WHEN 'click' THEN 'uploading' WHEN 'view' THEN 'failed' WHEN 'purchase' THEN 'embedding' END AS state, CASE WHEN event_id % 2 = 0 THEN 'upload_expired' END AS e FROM events)"""
)
def upload_resume(spark, d):
    k, t = F.col("event_id") % 7, F.col("event_type")
    state = F.when(t == "click", "uploading").when(t == "view", "failed").when(t == "purchase", "embedding")
    path = F.when(k == 4, "u1/d1/../x").otherwise("u1/d1/x")
    decision = E.resume_decision(k != 6, F.when(k == 5, "ready").otherwise("processing"), state, F.when(F.col("event_id") % 2 == 0, "upload_expired"), T.safe_path(path, F.lit("u1"), F.lit("d1")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), decision.alias("decision"))


@query(
    f"""WITH d AS (SELECT id, status, status = 'ready' AND id % 6 = 0 AS seal FROM {DOCS_SQL}) SELECT 'document' AS kind, id, CASE WHEN seal THEN 'sealed' ELSE status END AS state FROM d
UNION ALL SELECT CASE WHEN coalesce(seal, false) THEN 'tombstone' ELSE 'chunk' END, vec_id, NULL FROM embeddings LEFT JOIN d ON id = vec_id UNION ALL SELECT 'sealed_chunk', id, 'c' || id FROM d WHERE seal"""
)
def seal_documents(spark, d):
    docs = Vault(spark, d).documents().select(F.col("id").alias("document"), "status")
    chunks = Vault(spark, d).all_vectors().select(F.col("id").alias("chunk"), F.col("id").alias("document"))
    cipher = docs.where("document % 6 = 0").select("document", F.lit(0).alias("ordinal"), F.concat(F.lit("c"), F.col("document").cast("string")).alias("ciphertext"), F.lit("s").alias("salt"), F.lit("n").alias("nonce"))
    out = E.seal({"documents": docs, "chunks": chunks, "generations": docs.select("document"), "sealed_chunks": cipher.where("false"), "tombstones": chunks.where("false")}, cipher)
    row = lambda df, kind, i, state: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), state.alias("state"))
    none = F.lit(None).cast("string")
    return row(out["documents"], "document", "document", F.col("status")).unionByName(row(out["chunks"], "chunk", "chunk", none)).unionByName(row(out["tombstones"], "tombstone", "chunk", none)).unionByName(row(out["sealed_chunks"], "sealed_chunk", "document", F.col("ciphertext")))


@query("SELECT doc_id AS id, trunc(0.1::DOUBLE * w)::INT AS x0, trunc(0.25::DOUBLE * h)::INT AS y0, greatest(1, trunc(0.5::DOUBLE * w)::INT) AS x1, 1 AS y1 FROM (SELECT doc_id, n_chars % 5000 + 1 AS w, doc_id * 37 % 3000 + 1 AS h FROM documents)")
def crop_boxes(spark, d):
    box = F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.0)])
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), E.crop_box(box, F.col("n_chars") % 5000 + 1, F.col("doc_id") * 37 % 3000 + 1).alias("b"))
    return rows.select("id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    """WITH r AS (SELECT user_id AS qid, event_id AS position, event_id % 9 AS region, 300000 + event_id % 11 * 150000 AS n FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 9 > 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, region ORDER BY position) AS k FROM r) WHERE k = 1),
s AS (SELECT *, sum(4 * ((n + 2) // 3)) OVER w AS total, count(*) OVER w AS c FROM f WINDOW w AS (PARTITION BY qid ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT qid, position, region FROM s WHERE total <= 6291456 AND c <= 4"""
)
def visual_budget(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "view", "chart").when(t == "purchase", "table").otherwise("paragraph")
    rows = table(spark, d, "events").select(F.col("user_id").alias("qid"), i.alias("position"), F.when(i % 9 > 0, i % 9).alias("region"), kind.alias("region_type"), (300_000 + i % 11 * 150_000).alias("n_bytes"))
    return E.visual_budget(rows).select("qid", "position", "region")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || (p_partkey % 2 + 1) ELSE p_name END AS name FROM part UNION ALL SELECT -1 - p_partkey, 'new 1' FROM part WHERE p_partkey % 30 = 0")
def upsert_rows(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    third = base.where("id % 3 = 0")
    change = lambda ids, n: ids.select("id", F.concat(F.lit("new "), n.cast("string")).alias("name"), n.alias("version"))
    changes = change(third, F.lit(1)).unionByName(change(third.where("id % 2 = 1"), F.lit(2))).unionByName(change(base.where("id % 30 = 0").select((-1 - F.col("id")).alias("id")), F.lit(1)))
    return sinks.upserted(base, changes, ["id"], "version").select("id", "name")


@query("SELECT o_orderkey AS id, count(l_partkey) AS n, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_children(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    rows = sinks.with_children(parents, lines, "id", "lines", ["l_linenumber", "l_partkey"])
    return rows.select("id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("chunks"))


@query(
    """WITH r AS (SELECT doc_id // 10 AS document, doc_id % 10 // 5 AS surface, doc_id % 10 AS ordinal, CASE WHEN doc_id % 10 > 0 THEN 0 END AS parent FROM documents), g AS (SELECT *, sha256('generation/' || document || '/3') AS generation FROM r)
SELECT 'region' AS kind, sha256('region/' || generation || '/' || ordinal) AS id, sha256('surface/' || document || '/' || surface) AS owner, CASE WHEN parent = 0 THEN sha256('region/' || generation || '/0') END AS parent FROM g
UNION ALL SELECT DISTINCT 'surface', sha256('surface/' || document || '/' || surface), document::VARCHAR, NULL FROM g UNION ALL SELECT 'generation', generation, document::VARCHAR, count(*)::VARCHAR FROM g GROUP BY document, generation"""
)
def layout_rows(spark, d):
    k = F.col("doc_id") % 10
    regions = table(spark, d, "documents").select(F.expr("doc_id div 10").alias("document"), F.expr("doc_id % 10 div 5").alias("surface"), k.alias("ordinal"), F.when(k > 0, F.lit(0).cast("long")).alias("parent"), F.lit("paragraph").alias("region_type"), F.col("text").alias("content"))
    out, none = E.layout_rows(regions, 3), F.lit(None).cast("string")
    row = lambda df, kind, i, owner, parent: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(owner).cast("string").alias("owner"), parent.alias("parent"))
    return row(out["regions"], "region", "id", "surface_id", F.col("parent_id")).unionByName(row(out["surfaces"], "surface", "id", "document", none)).unionByName(row(out["generations"], "generation", "generation", "document", F.col("n_regions").cast("string")))


@query(
    """WITH g AS (SELECT event_id AS generation, (props->>'k')::INT AS k FROM events WHERE event_type <> 'view'),
x AS (SELECT *, list_sort(list_distinct([k % 3, k % 5, k % 2])) AS done FROM g)
SELECT generation, '{"complex_surfaces":' || to_json(range(k % 4)) || ',"enriched_surfaces":' || to_json(done) || ',"k":' || k || '}' AS checkpoint,
CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE ELSE least(1.0, len(done)::DOUBLE / (k % 4)) END AS completeness, CASE WHEN k % 4 = 0 OR len(done) >= k % 4 THEN 'active' ELSE 'partial' END AS state FROM x"""
)
def checkpoints(spark, d):
    """JSON checkpoints of generations after two of their surfaces were enriched."""
    k = V.at(V.parsed(F.col("props")), "$.k", "int")
    rows = table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_id").alias("generation"), k.alias("k"), V.parsed(F.col("props")).alias("v"))
    surfaces = F.filter(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(i < F.col("k") % 4, i)), lambda i: i.isNotNull())
    before = V.with_path(V.with_path(F.col("v"), ["enriched_surfaces"], V.from_value(F.array(F.col("k") % 3))), ["complex_surfaces"], V.from_value(surfaces))
    done = rows.select("generation", F.explode(F.array(F.col("k") % 5, F.col("k") % 2)).alias("surface"))
    return E.checkpointed(rows.select("generation", F.to_json(before).alias("checkpoint")), done)
