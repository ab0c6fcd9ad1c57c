"""Queries on listings, ownership, captures, renames, wipes, composed clustering, and writers."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import text as T
from tessera.operators import changes as G
from tessera.operators import layout as L
from tessera.operators import library as B
from tessera.operators import retrieval as R
from tessera.plans.graph import kmeans_sql, seeds_sql
from tessera.plans.registry import query
from tessera.sources import pages, sinks
from tessera.sources.scratch import new_path
from tessera.sources.vault import DOCS_SQL, Vault, files, table

NOW = "2024-01-15 00:00:00"


@query("SELECT event_id AS id, user_id, nth, (nth - 1) // 5 AS page FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events)".replace("nth, (nth - 1) // 5 AS page", "nth::INT AS nth, ((nth - 1) // 5)::INT AS page"))
def newest_first(spark, d):
    """Each user's rows by time, newest first, in stable pages of five."""
    rows = B.listed(table(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id")])
    return rows.select(F.col("event_id").alias("id"), "user_id", "nth", "page")


@query("SELECT conv_id AS session, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS nth FROM conversations")
def by_ordinal(spark, d):
    return B.listed(Vault(spark, d).messages(), "session", [F.col("turn")]).select("session", "turn", "nth")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN left(text, 20) ELSE 'file ' || id END AS text, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty_text' WHEN length(text) > 20000 THEN 'text_too_long' WHEN id % 7 = 0 THEN 'empty_title' WHEN id % 11 = 0 THEN 'title_too_long' END AS problem FROM {DOCS_SQL}")
def captures(spark, d):
    i = F.col("id")
    title = F.when(i % 7 == 0, " ").when(i % 11 == 0, F.repeat(F.lit("x"), F.lit(501)))
    text = T.extraction_source(F.when(i % 2 == 0, "capture").otherwise("upload"), F.substring("text", 1, 20), F.concat(F.lit("file "), i.cast("string")))
    return Vault(spark, d).documents().select("id", text.alias("text"), T.capture_problem(F.col("text"), title).alias("problem"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'lang=' || coalesce(lang, 'none') || ',size=big' WHEN id % 3 = 1 THEN 'lang=' || coalesce(lang, 'none') || ',size=' || size ELSE 'lang=xx,size=' || size || ',tag=new' END AS meta FROM {DOCS_SQL}")
def merged_meta(spark, d):
    i = F.col("id")
    left = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("none")), F.lit("size"), F.col("size").cast("string"))
    right = F.when(i % 3 == 0, F.create_map(F.lit("size"), F.lit("big"))).when(i % 3 == 2, F.create_map(F.lit("lang"), F.lit("xx"), F.lit("tag"), F.lit("new")))
    pairs = F.array_sort(F.transform(F.map_entries(B.merged_meta(left, right)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return Vault(spark, d).documents().select("id", F.array_join(pairs, ",").alias("meta"))


_HELD = "h AS (SELECT DISTINCT p_partkey % 10 AS user_id, p_partkey AS chunk FROM part WHERE p_size < 25)"


def _held(spark, d):
    return table(spark, d, "part").where("p_size < 25").select((F.col("p_partkey") % 10).alias("user"), F.col("p_partkey").alias("chunk"))


@query(f'WITH {_HELD} SELECT DISTINCT l_orderkey % 10 AS "user", l_partkey AS chunk FROM lineitem JOIN h ON h.user_id = l_orderkey % 10 AND h.chunk = l_partkey')
def owned_recent(spark, d):
    """Of the chunks that answers have shown, each user's own: only these are reinforced."""
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("user"), F.col("l_partkey").alias("chunk"))
    return B.owned(asked, _held(spark, d))


@query("SELECT DISTINCT l_partkey AS chunk FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_chunks(spark, d):
    return B.missing(table(spark, d, "lineitem").select(F.col("l_partkey").alias("chunk")), _held(spark, d), "chunk")


@query(f'WITH {_HELD}, l AS (SELECT DISTINCT p_partkey % 10 AS u, p_partkey AS a, p_partkey + 10 AS b FROM part) SELECT u AS "user", a, b FROM l WHERE (u, a) IN (SELECT user_id, chunk FROM h) AND (u, b) IN (SELECT user_id, chunk FROM h)')
def owned_links(spark, d):
    p = F.col("p_partkey")
    links = table(spark, d, "part").select((p % 10).alias("user"), (p + 10).alias("a"), p.alias("b"))
    return B.owned_links(links, _held(spark, d))


@query(f"SELECT event_id AS id, k % 2 = 1 AS done, CASE WHEN k % 2 = 1 THEN CASE WHEN k < 4 THEN epoch_us(ts) ELSE epoch_us(TIMESTAMP '{NOW}') END END AS completed_at FROM (SELECT *, event_id % 7 AS k FROM events)")
def todo_toggle(spark, d):
    k, done = F.col("event_id") % 7, F.col("event_id") % 7 % 2 == 1
    at = F.col("ts").cast("timestamp")
    was = F.when(k < 4, done).otherwise(~done)
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), was.alias("done"), F.when(was, at).alias("completed_at"))
    changes = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k >= 2, done).alias("done"))
    out = B.toggled(rows, changes, F.lit(NOW).cast("timestamp"))
    return out.select("id", "done", F.unix_micros("completed_at").alias("completed_at"))


@query("SELECT event_id AS id, coalesce(p, 'medium') AS priority, CASE WHEN event_id % 7 = 0 THEN 'done' ELSE 'open' END AS part, count(*) OVER (PARTITION BY user_id, event_id % 7 = 0) AS n FROM (SELECT *, CASE event_id % 7 WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS p FROM events)")
def todo_parts(spark, d):
    """To-dos by priority, none being medium, parted into open and done ones."""
    from pyspark.sql import Window

    k = F.col("event_id") % 7
    part = F.when(k == 0, "done").otherwise("open")
    rows = table(spark, d, "events").withColumns({"part": part, "priority": F.coalesce(F.when(k == 1, "low").when(k == 2, "high"), F.lit("medium"))})
    return rows.select(F.col("event_id").alias("id"), "priority", "part", F.count("*").over(Window.partitionBy("user_id", "part")).alias("n"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 > 0 THEN epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 2 = 1 THEN 7200000000 ELSE 0 END END AS at FROM events")
def iso_times(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 1, "+02:00").otherwise("Z"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, text).otherwise("no time").alias("text"))
    return rows.select("id", F.unix_micros(B.iso_time(F.col("text"))).alias("at"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 AND id % 4 > 0 THEN 'Renamed ' || id ELSE left(text, 10) END AS title FROM {DOCS_SQL}")
def renamed_documents(spark, d):
    docs = Vault(spark, d).documents().select("user_id", "id", F.substring("text", 1, 10).alias("title"))
    title = F.when(F.col("id") % 4 > 0, F.concat(F.lit(" Renamed "), F.col("id").cast("string"), F.lit(" "))).otherwise("  ")
    asked = docs.where("id % 3 <= 1").select(F.when(F.col("id") % 3 == 0, F.col("user_id")).otherwise("another").alias("user_id"), "id", title.alias("title"))
    return B.renamed(docs, asked).select("id", "title")


@query(f"SELECT user_id, count(*) AS documents_deleted, (SELECT count(*) FROM {DOCS_SQL} WHERE user_id NOT IN ('src1', 'src2')) AS n_left FROM {DOCS_SQL} WHERE user_id IN ('src1', 'src2') GROUP BY user_id UNION ALL SELECT 'nobody', 0, (SELECT count(*) FROM {DOCS_SQL} WHERE user_id NOT IN ('src1', 'src2'))".replace("user_id NOT IN ('src1', 'src2')", "coalesce(user_id, '') NOT IN ('src1', 'src2')"))
def account_wipe(spark, d):
    users = spark.createDataFrame([("src1",), ("src2",), ("nobody",), ("src1",)], "user_id string")
    left, counts = B.wiped({"documents": Vault(spark, d).documents()}, users)
    return counts.join(F.broadcast(left["documents"].agg(F.count("*").alias("n_left"))))  # one row


@query(f"SELECT x.id AS document, x.user_id, x.status, CASE WHEN e.event_type = 'view' THEN 'normalizing' ELSE 'embedding' END AS state FROM events e JOIN {DOCS_SQL} x ON x.id = e.event_id WHERE e.event_type IN ('view', 'purchase')")
def claimed_jobs(spark, d):
    jobs = table(spark, d, "events").where("event_type IN ('view', 'purchase')").select(F.col("event_id").alias("document"), F.when(F.col("event_type") == "view", "normalizing").otherwise("embedding").alias("state"))
    return B.with_documents(jobs, Vault(spark, d).documents().withColumnRenamed("id", "document"))


@query(f"SELECT doc_id AS region, (doc_id % 3)::BIGINT AS generation FROM documents WHERE doc_id % 3 = (doc_id // 10) % 3")
def active_regions(spark, d):
    i = F.col("doc_id")
    regions = table(spark, d, "documents").select(i.alias("region"), F.expr("doc_id div 10").alias("document"), (i % 3).alias("generation"))
    active = regions.select("document").distinct().select("document", (F.col("document") % 3).alias("active"))
    return L.active_regions(regions, active).select("region", "generation")


@query(
    f"""SELECT id, (generate_subscripts(o, 1) - 1)::INT AS nth, unnest(o) AS ordinal FROM (SELECT id, range(0, id % 4) AS o FROM {DOCS_SQL} WHERE status = 'ready' AND id % 4 > 0)
UNION ALL SELECT id, -1, CASE WHEN status = 'ready' THEN 0 END FROM {DOCS_SQL} WHERE status <> 'ready' OR id % 4 = 0"""
)
def satellites(spark, d):
    """-1 for a document without satellites: 0 where there are none, null where there can be none."""
    docs = Vault(spark, d).documents()
    chunks = docs.where("id % 4 > 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 4 - 1)).alias("ordinal"))
    rows = B.satellites(docs, chunks)
    some = rows.where(F.size("satellites") > 0).select("id", F.posexplode("satellites").alias("nth", "ordinal"))
    none = rows.where(F.col("satellites").isNull() | (F.size("satellites") == 0)).select("id", F.lit(-1).alias("nth"), F.when(F.col("satellites").isNotNull(), F.lit(0).cast("long")).alias("ordinal"))
    return some.unionByName(none)


@query(
    """WITH s AS (SELECT doc_id AS id, (n_chars % 5000 + 1)::INT AS w, (doc_id * 37 % 3000 + 1)::INT AS h FROM documents),
r AS (SELECT *, unnest(CASE WHEN greatest(w, h) <= 2048 THEN [0] ELSE range(0, h, 1024) END) AS y0 FROM s), q AS (SELECT *, unnest(CASE WHEN greatest(w, h) <= 2048 THEN [0] ELSE range(0, w, 1024) END) AS x0 FROM r)
SELECT id, round(x0 / w::DOUBLE, 6) AS x0, round(y0 / h::DOUBLE, 6) AS y0, round(CASE WHEN greatest(w, h) <= 2048 THEN 1.0 ELSE least(w, x0 + 1024) / w::DOUBLE END, 6) AS x1, round(CASE WHEN greatest(w, h) <= 2048 THEN 1.0 ELSE least(h, y0 + 1024) / h::DOUBLE END, 6) AS y1 FROM q"""
)
def image_regions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5000 + 1).cast("int").alias("width"), (F.col("doc_id") * 37 % 3000 + 1).cast("int").alias("height"))
    return L.image_regions(docs).select("id", *[F.round(F.col("bbox")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    """WITH b AS (SELECT doc_id // 10 AS page, doc_id % 10 AS o, CASE doc_id % 10 WHEN 0 THEN 'heading' WHEN 5 THEN 'heading' ELSE 'paragraph' END AS t FROM documents WHERE doc_id // 10 % 7 > 0),
g AS (SELECT DISTINCT doc_id // 10 AS page FROM documents), n AS (SELECT page, t, row_number() OVER (PARTITION BY page ORDER BY o) - 1 AS ordinal FROM b),
u AS (SELECT page, t, ordinal, CASE WHEN t = 'paragraph' THEN max(CASE WHEN t = 'heading' THEN ordinal END) OVER (PARTITION BY page ORDER BY ordinal) END AS parent FROM n)
SELECT g.page, coalesce(ordinal, 0)::INT AS ordinal, coalesce(t, 'image') AS region_type, parent::INT AS parent, t IS NULL OR g.page % 5 = 1 OR g.page % 30 > 20 OR g.page % 3 = 1 AS complex FROM g LEFT JOIN u ON u.page = g.page"""
)
def page_regions(spark, d):
    page, k = F.expr("doc_id div 10"), F.col("doc_id") % 10
    docs = table(spark, d, "documents").select(page.alias("page"), k.alias("reading_order"), F.when(k.isin(0, 5), "heading").otherwise("paragraph").alias("region_type"), F.col("text").alias("content"))
    p = F.col("page")
    pages = docs.select("page").distinct().select("page", (p % 5 == 1).cast("int").alias("images"), F.lit(0).alias("tables"), (p % 30).alias("drawings"), F.when(p % 3 == 1, 2).otherwise(1).alias("columns"))
    return L.page_regions(docs.where(p % 7 > 0), pages).select("page", "ordinal", "region_type", "parent", "complex")


@query(f"SELECT id, CASE id % 6 WHEN 0 THEN 'TXT' WHEN 1 THEN 'PDF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'ZIP' WHEN 4 THEN 'FILE' ELSE 'MD' END AS label, CASE WHEN status = 'sealed' THEN 'sealed' WHEN id % 6 = 1 THEN 'pdf' WHEN id % 6 = 2 THEN 'image' ELSE 'text' END AS colour FROM {DOCS_SQL}")
def type_labels(spark, d):
    k = F.col("id") % 6
    mime = F.when(k == 0, "text/plain").when(k == 1, "application/pdf").when(k == 2, "image/png").when(k == 3, "application/zip").when(k == 4, "broken").otherwise("text/markdown")
    return Vault(spark, d).documents().select("id", S.type_label(mime).alias("label"), B.node_colour(F.col("status"), mime).alias("colour"))


@query(f"SELECT id, 'list' AS place FROM {DOCS_SQL} WHERE status IN ('ready', 'sealed') AND contains(lower(left(text, 60)), 'the') UNION ALL SELECT id, 'all' FROM {DOCS_SQL}")
def titled_documents(spark, d):
    docs = Vault(spark, d).documents().withColumn("title", F.substring("text", 1, 60))
    found = B.titled(docs, " The ", True, ["ready", "sealed"]).select("id", F.lit("list").alias("place"))
    return found.unionByName(B.titled(docs, " ", True).select("id", F.lit("all").alias("place"))).unionByName(B.titled(docs, "", False).select("id", F.lit("graph").alias("place")))


_EMPTY = f"(SELECT id, user_id AS document, id // 3 AS region, CASE WHEN id % 4 = 0 THEN '' ELSE left(text, 12) END AS content FROM {DOCS_SQL} WHERE status = 'ready')"


def _candidates(spark, d):
    content = F.when(F.col("id") % 4 == 0, "").otherwise(F.substring("text", 1, 12))
    return Vault(spark, d).searchable().select("id", F.col("user_id").alias("document"), F.expr("id div 3").alias("region"), content.alias("content"))


@query(f"SELECT id, CASE WHEN region % 2 > 0 THEN content WHEN content = '' THEN 'before ' || region || chr(10) || chr(10) || 'after' WHEN content = 'after' THEN 'after' || chr(10) || chr(10) || 'before ' || region ELSE content || chr(10) || chr(10) || 'before ' || region || chr(10) || chr(10) || 'after' END AS content FROM {_EMPTY}")
def expanded_context(spark, d):
    """Candidates with what their regions' contexts add; a text that stands there twice comes once."""
    rows = _candidates(spark, d)
    even = rows.where("region % 2 = 0").select("region").distinct()
    said = F.array(F.concat(F.lit("before "), F.col("region").cast("string")), F.lit("after"), F.lit(""), F.lit("after"))
    return R.with_context(rows, even.select("region", F.posexplode(said).alias("position", "content"))).select("id", "content")


@query(f"SELECT id, CASE WHEN content = '' AND document <> 'src1' THEN 'about ' || document ELSE content END AS content FROM {_EMPTY}")
def caption_fallback(spark, d):
    rows = _candidates(spark, d)
    captions = rows.where("document <> 'src1'").select("document").distinct().select("document", F.concat(F.lit("about "), "document").alias("caption"))
    return R.with_captions(rows, captions).select("id", "content")


@query(f"SELECT qid, id, region FROM (SELECT id // 50 AS qid, id, region, row_number() OVER (PARTITION BY id // 50 ORDER BY id) AS n FROM {_EMPTY} WHERE content = '' AND id % 3 > 0) WHERE n <= 4")
def regions_to_enrich(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "paragraph").when(F.col("id") % 3 == 1, "chart").otherwise("table")
    rows = _candidates(spark, d).select(F.expr("id div 50").alias("qid"), "id", F.col("id").alias("position"), "region", kind.alias("region_type"), "content")
    return R.to_enrich(rows)


@query(f"SELECT id, length(left(text, 6000))::INT AS rerank, length(left(text, 3000))::INT AS history FROM {DOCS_SQL}")
def prompt_cuts(spark, d):
    return Vault(spark, d).documents().select("id", F.length(T.for_rerank(F.col("text"))).alias("rerank"), F.length(T.for_history(F.col("text"))).alias("history"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'text' ELSE 'vector' END AS leg FROM {DOCS_SQL} WHERE status = 'ready' AND (id % 2 = 0 OR id % 3 = 0)")
def merged_legs(spark, d):
    """Rows of a vector leg and of a text leg, one an id; the text leg's row wins."""
    docs = Vault(spark, d).searchable().select("id")
    return R.merged_rows([docs.where("id % 2 = 0").withColumn("leg", F.lit("vector")), docs.where("id % 3 = 0").withColumn("leg", F.lit("text"))])


@query(f"SELECT provider, id, rank FROM (SELECT provider, id, (row_number() OVER (PARTITION BY provider ORDER BY size DESC, id))::INT AS rank FROM {DOCS_SQL} WHERE status = 'ready' AND provider <> 'p2') WHERE rank <= 20")
def provider_legs(spark, d):
    """The legs of three providers as one; one of them is down."""
    from pyspark.sql import Window

    docs = Vault(spark, d).searchable()

    def leg(name):
        if name == "p2":
            raise ConnectionError(name)
        rank = F.row_number().over(Window.orderBy(F.col("size").desc(), "id"))
        best = docs.where(F.col("provider") == name).orderBy(F.col("size").desc(), "id").limit(20)
        return best.select("provider", "id", rank.alias("rank"))

    return R.legs_by_provider({f"p{k}": lambda k=k: leg(f"p{k}") for k in range(3)})


_MEANS = f"""e AS (SELECT substr(x.user_id, 4)::BIGINT AS id, (e.embedding)::DOUBLE[] AS x FROM embeddings e JOIN {DOCS_SQL} x ON x.id = e.vec_id WHERE x.status = 'ready'),
v AS MATERIALIZED (SELECT id, list(y ORDER BY p) AS x FROM (SELECT id, p, avg(x[p]) AS y FROM e, range(1, 65) t(p) GROUP BY id, p) GROUP BY id)"""


@query(kmeans_sql(3, 4, _MEANS, seeds_sql(3)))
def clustered_documents(spark, d):
    """Documents by the mean of their vectors, in three clusters."""
    docs = Vault(spark, d).searchable().select("id", F.substring("user_id", 4, 10).cast("long").alias("document"))
    found = B.cluster_documents(Vault(spark, d).vectors().join(docs, "id").select("document", "embedding"), 3, iterations=4, rounds=0)
    return found.select("id", "cluster", F.round("distance", 5).alias("distance"))


@query("SELECT page_id % 5 AS user_id, count(*) AS n, sum(page_id)::BIGINT AS total FROM pages WHERE page_id % 5 <> 2 GROUP BY ALL UNION ALL SELECT 2, count(*), sum(page_id + 1000)::BIGINT FROM pages WHERE page_id % 5 = 2".replace("page_id % 5 AS user_id", "(page_id % 5)::INT AS user_id"))
def replaced_tenants(spark, d):
    """A table of all tenants in which one tenant's rows are replaced, read back."""
    path = new_path(spark, "tenants")
    rows = table(spark, d, "pages").select((F.col("page_id") % 5).cast("int").alias("user_id"), F.col("page_id").alias("id"))
    sinks.replace_tenants(rows, path)
    sinks.replace_tenants(rows.where("user_id = 2").withColumn("id", F.col("id") + 1000), path)
    return spark.read.schema("id long, user_id int").parquet(path).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("SELECT event_id AS id, event_type AS title FROM events WHERE event_id % 3 < 2")
def appended_rows(spark, d):
    """Two appends whose rows pass their checks, and one that fails as a whole."""
    path = new_path(spark, "appended")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"))
    checks = {"title": F.length("title") > 0, "id": F.col("id") >= 0}
    for k in range(2):
        sinks.append_checked(rows.where(F.col("id") % 3 == k), path, checks)
    try:
        sinks.append_checked(rows.where("id % 3 = 2").withColumn("title", F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("")), path, checks)
    except Exception as e:  # the broken rule comes as Spark's own error
        if "broken rule: title" not in str(e):
            raise
    return spark.read.schema("id long, title string").parquet(path)


@query(f"SELECT id, text AS source FROM {DOCS_SQL} WHERE id < 20 AND text IS NOT NULL AND length(text) > 0")
def text_files(spark, d):
    """Twenty documents written as files and read again, one row a file."""
    root = new_path(spark, "files")
    rows = Vault(spark, d).documents().where("id < 20 AND length(text) > 0")
    # one partition a file's folder, with the text as its only line
    rows.select(F.col("id").cast("string").alias("id"), "text").write.option("lineSep", "\u0001").partitionBy("id").text(root)
    found = files(spark, f"{root}/*")
    return found.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("long").alias("id"), F.rtrim(F.col("source"), F.lit("\u0001")).alias("source"))


@query(
    f"""SELECT page, min(id) AS first, max(id) AS last, count(DISTINCT id) AS n_documents, count(e.vec_id) AS n_vectors FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 5 AS page FROM {DOCS_SQL} WHERE status = 'ready') d
LEFT JOIN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) e ON e.vec_id = d.id GROUP BY page"""
)
def paged_scan(spark, d):
    """Pages of five ready documents in the order of ids, with how many vectors each page's documents have; all pages at once."""
    v = Vault(spark, d)
    rows = pages.paged(v.searchable().select("id"), ["id"], 5)
    vectors = v.all_vectors().where("embedding IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(vectors, "id", "left").groupBy("page").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"))


# Lines of orders as changes: by flag and quantity they make, delete or patch; one without discount is asked for by another user.
_LOG = """log AS (SELECT CASE WHEN l_discount = 0 THEN l_suppkey % 25 ELSE c_nationkey END AS "user", l_orderkey AS id, o_custkey AS board, epoch_us(l_shipdate) + l_linenumber::BIGINT * 1000000000 + l_partkey AS ts,
  CASE WHEN l_quantity <= 40 THEN 'update' WHEN l_returnflag = 'R' THEN 'delete' WHEN l_returnflag = 'A' THEN 'create' ELSE 'update' END AS op, l_linestatus = 'O' AS first, l_tax > 0.04 AS second,
  'part ' || l_partkey AS title, CASE WHEN l_tax >= 0.03 THEN 'p' || l_linenumber END AS note, l_returnflag AS flag, l_extendedprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


def _log(spark, d):
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, d, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("c_custkey") == F.col("o_custkey"))
    big, flag = F.col("l_quantity") > 40, F.col("l_returnflag")
    return rows.select(
        F.when(F.col("l_discount") == 0, F.col("l_suppkey") % 25).otherwise(F.col("c_nationkey")).cast("long").alias("user"),
        F.col("l_orderkey").alias("id"),
        F.col("o_custkey").alias("board"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("at"),
        F.when(big & (flag == "R"), "delete").when(big & (flag == "A"), "create").otherwise("update").alias("op"),
        (F.col("l_linestatus") == "O").alias("first"),
        (F.col("l_tax") > 0.04).alias("second"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_tax") >= 0.03, F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))).alias("note"),
        flag.alias("flag"),
        F.col("l_extendedprice").alias("price"),
    )


def _orders(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("user"))
    return table(spark, d, "orders").join(customers, "o_custkey").withColumn("title", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))


def _given(first, second, third):
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(F.col("first"), names(first)).when(F.col("second"), names(second)).otherwise(names(third))


@query(
    f"""WITH {_LOG}, f AS (SELECT "user", id, max(ts) FILTER (WHERE op = 'create') AS made, max(ts) FILTER (WHERE op = 'delete') AS gone,
  arg_max({{'v': title}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND NOT first)) AS t, arg_max({{'v': CASE WHEN op = 'create' THEN coalesce(note, 'medium') ELSE note END}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND NOT first AND second)) AS p,
  arg_max({{'v': flag = 'N', 'ts': CASE WHEN flag = 'N' THEN ts END}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND first)) AS c FROM log GROUP BY ALL),
b AS (SELECT c_nationkey AS "user", o_orderkey AS id, 'order ' || o_orderkey AS title, o_orderpriority AS priority, o_orderstatus = 'F' AS completed, CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) END AS completed_at FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT "user", id, CASE WHEN t IS NULL THEN title ELSE t.v END AS title, CASE WHEN p IS NULL THEN priority ELSE p.v END AS priority, CASE WHEN c IS NULL THEN completed ELSE c.v END AS completed, CASE WHEN c IS NULL THEN completed_at ELSE c.ts END AS completed_at
FROM b FULL JOIN f USING ("user", id) WHERE CASE WHEN made IS NOT NULL THEN gone IS NULL OR made > gone ELSE gone IS NULL AND title IS NOT NULL END"""
)
def changed_todos(spark, d):
    """To-dos after all users' changes: made, patched, completed, reopened and deleted."""
    todos = _orders(spark, d).select("user", F.col("o_orderkey").alias("id"), "title", F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("completed"), F.when(F.col("o_orderstatus") == "F", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("completed_at"))
    log = _log(spark, d).select("user", "id", "at", "op", "title", F.col("note").alias("priority"), (F.col("flag") == "N").alias("completed"), _given(["completed"], ["title", "priority"], ["completed_at", "title"]).alias("given"))
    return G.changed_todos(todos, log)


@query(
    f"""WITH {_LOG}, own AS (SELECT log.* FROM log SEMI JOIN customer ON c_custkey = board AND c_nationkey = "user" WHERE op = 'create' UNION ALL SELECT * FROM log WHERE op <> 'create'),
f AS (SELECT "user", id, max(ts) FILTER (WHERE op = 'create') AS made, max(ts) FILTER (WHERE op = 'delete') AS gone, max(board) FILTER (WHERE op = 'create') AS made_on,
  arg_max({{'v': flag}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND first)) AS l, arg_max({{'v': title}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND NOT first)) AS t,
  arg_max({{'v': note}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND NOT first AND second)) AS n, arg_max({{'v': CASE WHEN op <> 'create' THEN price END}}, ts) FILTER (WHERE op = 'create' OR (op = 'update' AND first)) AS p FROM own GROUP BY ALL),
b AS (SELECT c_nationkey AS "user", o_orderkey AS id, o_custkey AS board, o_orderstatus AS lane, 'order ' || o_orderkey AS title, o_orderpriority AS description, o_totalprice AS position FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT "user", id, coalesce(made_on, board) AS board, CASE WHEN l IS NULL THEN lane ELSE l.v END AS lane, CASE WHEN t IS NULL THEN title ELSE t.v END AS title, CASE WHEN n IS NULL THEN description ELSE n.v END AS description,
  CASE WHEN p IS NULL THEN position ELSE p.v END AS position, made FROM b FULL JOIN f USING ("user", id) WHERE CASE WHEN made IS NOT NULL THEN gone IS NULL OR made > gone ELSE gone IS NULL AND board IS NOT NULL END),
e AS (SELECT *, max(position) OVER w AS last, row_number() OVER (PARTITION BY "user", board, lane, position IS NULL ORDER BY made, id) AS nth FROM r WINDOW w AS (PARTITION BY "user", board, lane))
SELECT "user", id, board, lane, title, description, CASE WHEN position IS NULL THEN coalesce(last + 1000.0::DOUBLE, 0.0::DOUBLE) + 1000.0::DOUBLE * (nth - 1) ELSE position END AS position FROM e"""
)
def changed_cards(spark, d):
    """Boards after all users' changes: cards made on one's own boards, patched, moved and deleted."""
    cards = _orders(spark, d).select("user", F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("board"), F.col("o_orderstatus").alias("lane"), "title", F.col("o_orderpriority").alias("description"), F.col("o_totalprice").alias("position"))
    log = _log(spark, d).select("user", "id", "at", "op", "board", F.col("flag").alias("lane"), "title", F.col("note").alias("description"), F.col("price").alias("position"), _given(["lane", "position"], ["title", "description", "board"], ["title"]).alias("given"))
    boards = table(spark, d, "customer").select(F.col("c_custkey").alias("board"), F.col("c_nationkey").cast("long").alias("user"))
    return G.changed_cards(cards, log, boards)
