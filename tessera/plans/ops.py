"""Operations queries: jobs, limits, boards, todos, sealed content, deletion, evaluation."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import text as T
from tessera.operators import ops as O
from tessera.plans.registry import query
from tessera.sources.scratch import new_path
from tessera.sources.vault import DOCS_SQL, Vault, table
from tessera.streaming import limits

NOW = "2024-01-15 00:00:00"
_EVENTS = "(SELECT *, event_id % 7 AS k FROM events)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.col("event_id") % 7)


_LIMITED = """WITH RECURSIVE e AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT id, user_id, event_type, n, true AS allowed, [t] AS hits FROM e WHERE n = 1 UNION ALL
SELECT e.id, e.user_id, e.event_type, e.n, len(list_filter(r.hits, lambda h: e.t - h < 86400000000)) < 3,
CASE WHEN len(list_filter(r.hits, lambda h: e.t - h < 86400000000)) < 3 THEN list_append(list_filter(r.hits, lambda h: e.t - h < 86400000000), e.t) ELSE list_filter(r.hits, lambda h: e.t - h < 86400000000) END
FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1) SELECT user_id, event_type, id, allowed FROM r"""


@query(_LIMITED)
def rate_limit_log(spark, d):
    requests = _events(spark, d).withColumnRenamed("event_id", "id")
    return O.rate_limited(requests, 3, 86400.0, ["user_id", "event_type"]).drop("retry_after")


@query(f"SELECT user_id || '/' || event_type AS key, id, allowed FROM ({_LIMITED})")
def stream_rate_limit(spark, d):
    """The limiter as a stream over the same log, a batch for all of it."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    requests = stream.select(key.alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.drain(limits.rate_limit_stream(requests, 3, 86400.0))


@query(
    """WITH b AS (SELECT user_id AS job, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY job ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS new FROM b),
n AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY t ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT job, min(t) AS since, max(t) + 21600000000 AS until, count(*) AS beats FROM n GROUP BY job, nth HAVING max(t) + 21600000000 <= (SELECT max(t) FROM b) // 1000 * 1000"""
)
def stream_leases(spark, d):
    """Leases of six hours that heartbeats renewed, and that ran out while the stream went on."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    gone = limits.drain(limits.expired_leases(stream.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts")), 6 * 3600.0))
    return gone.select("job", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "beats")


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey AS turn, l_partkey AS chunk, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS ts FROM lineitem)
SELECT x.chunk AS a, y.chunk AS b, count(*) AS turns, epoch_us(max(x.ts)) AS last FROM t x JOIN t y ON x.turn = y.turn AND x.chunk < y.chunk GROUP BY ALL"""
)
def stream_reinforce(spark, d):
    """Co-retrieval edges from a stream of turns."""
    root = new_path(spark, "turns")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("turn")).agg(F.collect_set("l_partkey").alias("chunks"), F.max("l_shipdate").alias("ts"))
    lines.write.mode("overwrite").parquet(root)
    return limits.reinforce(spark.readStream.schema(lines.schema).parquet(root)).select("a", "b", "turns", F.unix_micros(F.col("last").cast("timestamp")).alias("last"))


_JOBS = f"""(SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'uploading' WHEN 'view' THEN 'normalizing' WHEN 'purchase' THEN 'embedding' ELSE 'failed' END AS state,
ts AS created_at, ts AS updated_at, CASE WHEN k < 3 THEN NULL ELSE ts + INTERVAL 10 MINUTE END AS lease_expires_at, NULL::VARCHAR AS last_error, CASE WHEN k % 2 = 0 THEN 'capture' ELSE 'upload' END AS source, k FROM {_EVENTS})"""


def _jobs(spark, d):
    t = F.col("event_type")
    state = F.when(t == "click", "uploading").when(t == "view", "normalizing").when(t == "purchase", "embedding").otherwise("failed")
    lease = F.when(F.col("k") >= 3, F.col("ts") + F.make_interval(mins=F.lit(10)))
    return _events(spark, d).select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), lease.alias("lease_expires_at"), F.lit(None).cast("string").alias("last_error"), F.when(F.col("k") % 2 == 0, "capture").otherwise("upload").alias("source"), "k")


@query(f"SELECT id, CASE WHEN late THEN 'failed' ELSE state END AS state, CASE WHEN late THEN 'upload_expired' ELSE last_error END AS last_error FROM (SELECT *, state = 'uploading' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS late FROM {_JOBS})")
def stalled_jobs(spark, d):
    return O.sweep_uploads(_jobs(spark, d), F.lit(NOW).cast("timestamp")).select("id", "state", "last_error")


@query(f"SELECT id, state, source FROM {_JOBS} WHERE state IN ('normalizing', 'extracting', 'embedding') AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AND (lease_expires_at IS NULL OR lease_expires_at < TIMESTAMP '{NOW}')")
def lease_recovery(spark, d):
    return O.recoverable(_jobs(spark, d), F.lit(NOW).cast("timestamp")).select("id", "state", "source")


@query(f"SELECT id, CASE WHEN state <> 'failed' THEN 'not_retryable' WHEN k = 1 THEN 'embedding' WHEN source = 'capture' THEN 'extracting' ELSE 'normalizing' END AS stage FROM {_JOBS}")
def retry_stage(spark, d):
    return _jobs(spark, d).select("id", O.retry_stage(F.col("state"), F.col("k") == 1, F.col("source")).alias("stage"))


@query(
    f"""SELECT id, CASE WHEN k = 6 THEN 'not_found' WHEN k = 5 THEN 'conflict' WHEN state IN ('normalizing', 'embedding') THEN 'already_started' WHEN NOT (state = 'uploading' AND k <> 4) THEN 'conflict'
WHEN k = 3 THEN 'upload_not_found' WHEN k = 2 THEN 'file_too_large' ELSE 'started' END AS decision FROM {_JOBS}"""
)
def upload_confirm(spark, d):
    k = F.col("k")
    state, status = F.when(k != 5, F.col("state")), F.when(k != 4, "processing").otherwise("ready")
    size = F.when(k == 2, 60_000_000).when(k != 3, 1000)
    return _jobs(spark, d).select("id", O.confirm_upload(k != 6, state, status, size).alias("decision"))


@query("SELECT user_id, event_type, coalesce(max(round(value, 2)) + 1000, 0) AS position FROM events GROUP BY ALL")
def card_append_position(spark, d):
    cards = _events(spark, d).withColumn("position", F.round("value", 2))
    return O.next_positions(cards, ["user_id", "event_type"])


@query(
    """SELECT id, round(CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN (a + b) / 2 WHEN b IS NOT NULL THEN b + 1000 WHEN a IS NOT NULL THEN a - 1000 ELSE 0 END, 6) AS position
FROM (SELECT event_id AS id, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def card_between(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select(F.col("event_id").alias("id"), F.round(S.position_between(F.lag("value").over(w), F.lead("value").over(w)), 6).alias("position"))


@query(f"SELECT event_id AS id, coalesce(p, 'medium') AS priority, k = 0 AS done FROM (SELECT *, CASE k WHEN 1 THEN 'low' WHEN 2 THEN 'high' END AS p FROM {_EVENTS}) WHERE coalesce(p, 'medium') = 'medium'")
def todo_filter(spark, d):
    k = F.col("k")
    priority = F.coalesce(F.when(k == 1, "low").when(k == 2, "high"), F.lit("medium"))
    return _events(spark, d).select(F.col("event_id").alias("id"), priority.alias("priority"), (k == 0).alias("done")).where("priority = 'medium'")


@query(f"SELECT event_id AS id, CASE WHEN k % 2 = 1 THEN 'new' ELSE event_type END AS title, CASE WHEN k % 3 = 1 THEN k ELSE user_id END AS owner FROM {_EVENTS}")
def todo_patch(spark, d):
    base = _events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("user_id").alias("owner"), "k")
    patch = base.select("id", F.when(F.col("k") % 2 == 1, "new").alias("title"), F.when(F.col("k") % 3 == 1, F.col("k")).alias("owner"))
    return O.patched(base, patch, "id", ["title", "owner"]).select("id", "title", "owner")


@query(f"SELECT user_id, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE status = 'sealed') AS n_sealed, least(100.0, round(100.0 * sum(size) / 200000, 6))::DOUBLE AS percent FROM {DOCS_SQL} GROUP BY user_id")
def storage_usage(spark, d):
    return O.storage_usage(Vault(spark, d).documents(), 200_000)


@query("SELECT 'chunks' AS kind, vec_id AS id, vec_id AS document FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 3) UNION ALL SELECT 'todos', event_id, CASE WHEN user_id % 10 = 3 AND user_id IN (SELECT doc_id FROM documents) THEN NULL ELSE user_id END FROM events")
def cascade_delete(spark, d):
    gone = table(spark, d, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").alias("document"))
    chunks = Vault(spark, d).all_vectors().select("id", F.col("id").alias("document"))
    todos = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document"))
    left = O.delete_documents({"chunks": chunks, "todos": todos}, gone, ["chunks"], ["todos"])
    return left["chunks"].select(F.lit("chunks").alias("kind"), "id", "document").unionByName(left["todos"].select(F.lit("todos").alias("kind"), "id", "document"))


@query(
    """SELECT round(coalesce(avg(quality::DOUBLE) FILTER (WHERE doc_id % 3 > 0), 0), 6) AS correct_page_rate, round(coalesce(avg(toxic::DOUBLE) FILTER (WHERE doc_id % 4 < 2), 0), 6) AS visual_recall_at_5,
round(coalesce(avg(quality::DOUBLE), 0), 6) AS citation_resolution_rate, round(coalesce(avg(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE toxic END::DOUBLE), 0), 6) AS answerable_accuracy FROM labels"""
)
def eval_metrics(spark, d):
    i, good, bad = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    kind = F.when(i % 4 == 0, "chart").when(i % 4 == 1, "table").otherwise("paragraph")
    rows = table(spark, d, "labels").select(F.when(i % 3 > 0, 1).alias("expected_page"), kind.alias("expected_region_type"), good.alias("correct_page"), bad.alias("retrieved_in_top_5"), good.alias("citations_resolved"), F.when(i % 5 != 0, bad).alias("answer_correct"))
    return O.evaluation(rows)


@query(f"SELECT id, CASE WHEN length(trim(t)) = 0 OR t IS NULL THEN CASE WHEN length(trim(text)) > 60 THEN left(trim(text), 60) || '…' ELSE trim(text) END ELSE trim(t) END AS title FROM (SELECT *, CASE WHEN id % 3 = 0 THEN ' given ' WHEN id % 3 = 1 THEN '  ' END AS t FROM {DOCS_SQL})")
def capture_titles(spark, d):
    given = F.when(F.col("id") % 3 == 0, " given ").when(F.col("id") % 3 == 1, "  ")
    return Vault(spark, d).documents().select("id", T.capture_title(given, F.col("text")).alias("title"))


@query(f"SELECT id, CASE WHEN id % 9 = 0 THEN 'unsupported_mime_type' WHEN size * 5000 > 52428800 THEN 'file_too_large' WHEN id % 7 = 0 THEN 'empty_title' WHEN length(trim(text)) > 500 THEN 'title_too_long' END AS problem FROM {DOCS_SQL}")
def upload_validation(spark, d):
    i = F.col("id")
    mime = F.when(i % 9 == 0, "video/mp4").otherwise("text/plain")
    return Vault(spark, d).documents().select("id", T.upload_problem(mime, F.col("size") * 5000, F.when(i % 7 == 0, " ").otherwise(F.col("text"))).alias("problem"))


@query(f"SELECT id, lower(left(text, 60)) AS title FROM {DOCS_SQL} WHERE contains(lower(left(text, 60)), 'the') AND status = 'ready'")
def title_search(spark, d):
    title = F.lower(F.substring("text", 1, 60))
    return Vault(spark, d).searchable().select("id", title.alias("title")).where(F.contains("title", F.lit("the")))


@query("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'chat' WHEN 2 THEN 'upload' WHEN 3 THEN 'seal_unseal' WHEN 4 THEN 'graph' ELSE 'general' END AS class FROM events")
def route_classes(spark, d):
    k = F.col("event_id") % 6
    path = F.when(k == 0, "/health").when(k == 1, "/api/v1/chat/sessions/7/stream").when(k == 2, "/api/v1/documents/upload-init").when(k == 3, "/api/v1/documents/7/seal").when(k == 4, "/api/v1/graph/recluster").otherwise("/api/v1/documents/upload-init")
    method = F.when(k == 5, "GET").otherwise("POST")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.route_class(path, method).alias("class"))


@query("SELECT user_id, max(ts)::VARCHAR AS last FROM (SELECT user_id, ts + INTERVAL 15 MINUTE AS ts FROM events) GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-29 12:00:00'".replace("max(ts)::VARCHAR AS last", "epoch_us(max(ts)) AS last"))
def unlock_claims(spark, d):
    claims = _events(spark, d).select(F.col("user_id").alias("document"), (F.col("ts") + F.make_interval(mins=F.lit(15))).alias("expires_at"))
    live = O.live_claims(claims, F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return live.select(F.col("document").alias("user_id"), F.unix_micros("expires_at").alias("last"))


@query(f"SELECT id, text AS plain, true AS opened FROM {DOCS_SQL} WHERE status = 'sealed' AND id % 2 = 0 UNION ALL SELECT id, NULL, false FROM {DOCS_SQL} WHERE status = 'sealed' AND id % 2 <> 0")
def sealed_decrypt(spark, d):
    """Sealed text opens with its own key alone; a wrong key gives null."""
    right, wrong = F.lit("0123456789abcdef0123456789abcdef"), F.lit("fedcba9876543210fedcba9876543210")
    raw = F.aes_encrypt("text", right, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lpad(F.hex("id"), 24, "0")))
    sealed = Vault(spark, d).documents().where("status = 'sealed'").select("id", raw.alias("raw"))
    rows = sealed.select("id", F.base64(F.substring("raw", 1, 12)).alias("nonce"), F.base64(F.expr("substring(raw, 13)")).alias("ciphertext"))
    opened = O.decrypted(rows, F.when(F.col("id") % 2 == 0, right).otherwise(wrong))
    return opened.select("id", "plain", F.col("plain").isNotNull().alias("opened"))


@query(
    """WITH j AS (SELECT o_orderkey AS document, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'p1' END AS provider, o_orderkey % 3 - 1 AS checkpoint FROM orders),
c AS (SELECT document, ordinal, max(e) AS error FROM (SELECT l_orderkey AS document, l_linenumber AS ordinal, CASE WHEN l_partkey % 7 = 0 THEN 'rate_limited' END AS e FROM lineitem) GROUP BY ALL),
l AS (SELECT c.* FROM c JOIN j USING (document) WHERE ordinal > checkpoint), s AS (SELECT document, min(ordinal) FILTER (WHERE error IS NOT NULL) AS stop FROM l GROUP BY document),
n AS (SELECT document, max(ordinal) AS last, count(*) AS n FROM l JOIN s USING (document) WHERE stop IS NULL OR ordinal < stop GROUP BY document)
SELECT document, CASE WHEN provider = 'p1' THEN coalesce(last, checkpoint) ELSE checkpoint END AS checkpoint, CASE WHEN provider = 'p1' AND stop IS NULL THEN 'ready' ELSE 'failed' END AS state,
CASE WHEN provider <> 'p1' THEN 'provider_not_configured' WHEN stop IS NOT NULL THEN 'rate_limited' END AS last_error, CASE WHEN provider = 'p1' THEN coalesce(n, 0) ELSE 0 END AS n_new FROM j LEFT JOIN s USING (document) LEFT JOIN n USING (document)"""
)
def embed_outcomes(spark, d):
    i = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(i.alias("document"), F.when(i % 5 == 0, "other").otherwise("p1").alias("provider"), (i % 3 - 1).alias("checkpoint"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").cast("long").alias("ordinal")).agg(F.max(F.when(F.col("l_partkey") % 7 == 0, "rate_limited")).alias("error"))
    return O.embed_outcomes(lines, jobs, ["p1"])


@query(f"SELECT event_id AS id, user_id AS board, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END ELSE 'todo' END AS \"column\" FROM {_EVENTS} WHERE k > 0 AND user_id % 3 > 0")
def agent_cards(spark, d):
    e, u = _events(spark, d), F.col("user_id")
    asked = e.where("k > 0").select(F.col("event_id").alias("id"), u.alias("board"), F.col("event_type").alias("column"), F.lit("x").alias("title"))
    boards = e.where(u % 3 > 0).select(u.alias("board"), F.when(u % 2 == 0, F.array(F.lit("view"), F.lit("click"))).otherwise(F.array(F.lit("todo"))).alias("columns")).distinct()
    return O.agent_cards(asked, boards).select("id", "board", "column")


@query(f"SELECT c.event_id AS claim, d.id AS document, 'c' || d.id AS ciphertext FROM events c JOIN {DOCS_SQL} d ON d.id = c.user_id WHERE d.status = 'sealed' AND c.event_id % 3 > 0 AND c.ts + INTERVAL 15 MINUTE > TIMESTAMP '2024-01-10 00:00:00'")
def claimed_sealed(spark, d):
    e = _events(spark, d)
    claims = e.select(F.col("event_id").alias("claim"), F.col("user_id").alias("document"), (F.col("ts") + F.make_interval(mins=F.lit(15))).alias("expires_at"))
    asked = e.select(F.col("event_id").alias("claim"), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("document"))
    sealed = Vault(spark, d).documents().where("status = 'sealed'").select(F.col("id").alias("document"), F.col("id").alias("ordinal"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("ciphertext"))
    return O.opened(claims, asked, sealed, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("claim", F.col("ordinal").alias("document"), "ciphertext")


@query("SELECT event_id AS id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS DISTINCT FROM event_type")
def change_feed(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("id"), "user_id", "event_type", "ts")
    return O.changes(rows, "user_id", ["ts", "id"], ["event_type"]).select("id", "user_id", "event_type")


@query(f"SELECT id, id % 9 <> 0 AND NOT contains(lower(CASE WHEN length(trim(text)) > 60 THEN left(trim(text), 60) || '…' ELSE trim(text) END), 'on') AS dim FROM {DOCS_SQL}")
def dimmed_nodes(spark, d):
    nodes = Vault(spark, d).documents().select("id", T.capture_title(F.lit(None).cast("string"), F.col("text")).alias("title"))
    return O.dimmed(nodes, " ON ", F.col("id") % 9 == 0).select("id", "dim")


@query(f"SELECT user_id, count(*) FILTER (WHERE id % 4 = 0) AS n, count(*) FILTER (WHERE id % 4 = 0) + 1 >= 10 AS recluster FROM {DOCS_SQL} GROUP BY user_id")
def recluster_needed(spark, d):
    rows = Vault(spark, d).documents().select("user_id", F.when(F.col("id") % 4 == 0, "incremental").otherwise("kmeans").alias("method"))
    return O.needs_recluster(rows)


@query(f"SELECT user_id, provider FROM {DOCS_SQL} WHERE status = 'ready' GROUP BY ALL")
def providers_in_use(spark, d):
    return Vault(spark, d).searchable().where(F.col("provider").isNotNull()).select("user_id", "provider").distinct()


@query("SELECT vec_id AS id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS squares FROM embeddings")
def parsed_vectors(spark, d):
    """Vectors that came as JSON text."""
    from tessera.functions import vectors as V

    sent = Vault(spark, d).all_vectors().select("id", F.to_json("embedding").alias("text"))
    v = sent.select("id", V.parse_vector(F.col("text")).alias("v"))
    return v.select("id", F.size("v").alias("n"), F.round(V.dot(F.col("v"), F.col("v")), 5).alias("squares"))
