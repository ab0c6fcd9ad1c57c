"""Chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chat as C
from tessera.plans.registry import query
from tessera.sources.scratch import new_path
from tessera.sources.vault import DOCS_SQL, Vault
from tessera.streaming import events

_MSG = "(SELECT conv_id AS session, turn, role, text AS content FROM conversations)"
_TOK = "greatest(1, round_even(length({0}) / 4.0, 0))::BIGINT"


@query(
    f"""SELECT session, CASE WHEN length(c) > 80 THEN left(c, 80) || '…' ELSE c END AS preview, n_messages
FROM (SELECT session, (min({{'turn': turn, 'c': content}}) FILTER (WHERE role = 'user')).c AS c, count(*) AS n_messages FROM {_MSG} GROUP BY session)"""
)
def session_preview(spark, d):
    return C.session_previews(Vault(spark, d).messages())


@query(f"SELECT session, turn, role, row_number() OVER (PARTITION BY session ORDER BY back DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC, content DESC) AS back FROM {_MSG}) WHERE back <= 6", rank="place")
def recent_messages(spark, d):
    return C.recent(Vault(spark, d).messages()).select("session", "turn", "role", "place")


_ASKED = f"""(SELECT *, coalesce((max(CASE WHEN role = 'user' THEN {{'turn': turn, 'c': content}} END) OVER (PARTITION BY session ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).c, '') AS question FROM {_MSG})"""


@query(f"SELECT session, turn, question FROM {_ASKED} WHERE role = 'assistant'")
def preceding_user_message(spark, d):
    return C.with_question(Vault(spark, d).messages()).select("session", "turn", "question")


@query(f"SELECT session, turn, i AS tokens_in, o AS tokens_out, round_even((i * 3 + o * 25) / 10.0::DOUBLE, 0) / 1e6::DOUBLE AS cost FROM (SELECT session, turn, {_TOK.format('question')} AS i, {_TOK.format('content')} AS o FROM {_ASKED} WHERE role = 'assistant')")
def prompt_cost(spark, d):
    return C.prompt_costs(Vault(spark, d).messages())


@query(f"SELECT session, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(300 + 1.1 * sum(i), 0) AS latency_ms FROM (SELECT session, {_TOK.format('question')} AS i, {_TOK.format('content')} AS o FROM {_ASKED} WHERE role = 'assistant') GROUP BY session".replace("round(300 + 1.1 * sum(i), 0)", "floor((3005 + 11 * sum(i)) / 10.0)::BIGINT"))
def session_totals(spark, d):
    per = C.prompt_costs(Vault(spark, d).messages()).groupBy("session").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return per.withColumn("latency_ms", F.floor((3005 + 11 * F.col("tokens_in")) / 10))


# Markers are made from turn and session numbers; one in seven is unknown.
_CITED = f"""c AS (SELECT session, turn, k AS chunk, pos FROM (SELECT session, turn, unnest(ids) AS k, generate_subscripts(ids, 1) AS pos FROM
(SELECT session, turn, [(session % 97)::VARCHAR, (turn + 3)::VARCHAR, CASE WHEN turn % 2 = 0 THEN 'none' ELSE ((session + turn) % 89)::VARCHAR END] AS ids FROM {_MSG} WHERE role = 'assistant')) WHERE k <> 'none'),
one AS (SELECT session, turn, chunk, min(pos) AS pos FROM c GROUP BY ALL),
cited AS (SELECT session, turn, chunk, row_number() OVER (PARTITION BY session, turn ORDER BY pos) AS place FROM one)"""


def _marked(spark, d):
    """Messages; the assistant's with markers instead of their text."""
    s, t = F.col("session"), F.col("turn")
    mark = lambda x: F.concat(F.lit("[[chunk:"), x.cast("string"), F.lit("]]"))
    text = F.concat(F.lit("see "), mark(s % 97), F.lit(" and [[chunk:"), (t + 3).cast("string"), F.lit("], [chunk:"), (s % 97).cast("string"), F.lit("]] "), F.when(t % 2 == 0, F.lit("[[chunk:none]]")).otherwise(mark((s + t) % 89)))
    return Vault(spark, d).messages().withColumn("content", F.when(F.col("role") == "assistant", text).otherwise(F.col("content")))


def _cited(spark, d):
    s, t = F.col("session"), F.col("turn")
    allowed = F.array((s % 97).cast("string"), (t + 3).cast("string"), ((s + t) % 89).cast("string"))
    return C.citations(_marked(spark, d).where("role = 'assistant'"), allowed)


@query(f"WITH {_CITED} SELECT session, turn, chunk, place FROM cited", rank="place")
def citations_extract(spark, d):
    return _cited(spark, d)


@query(f"WITH {_CITED} SELECT session, chunk, row_number() OVER (PARTITION BY session ORDER BY seen) AS number FROM (SELECT session, chunk, min({{'turn': turn, 'place': place}}) AS seen FROM cited GROUP BY ALL)", rank="number")
def conversation_export(spark, d):
    return C.export_numbers(_cited(spark, d))


@query(
    f"""WITH {_CITED}, o AS (SELECT id::VARCHAR AS chunk, user_id AS document, status FROM {DOCS_SQL} WHERE status IN ('ready', 'sealed'))
SELECT session, turn, array_to_string(list_sort(list(DISTINCT document)), ',') AS documents FROM cited JOIN o USING (chunk) GROUP BY session, turn"""
)
def replay_documents(spark, d):
    docs = Vault(spark, d).documents().select(F.col("id").cast("string").alias("chunk"), F.col("user_id").alias("document"), "status")
    rows = C.replay(_cited(spark, d), docs.where("status = 'ready'"), docs.where("status = 'sealed'"))
    return rows.select("session", "turn", F.array_join("documents", ",").alias("documents"))


_WORDS = ", ".join(f"'{w}'" for w in T.GENERIC_WORDS)
_BARE = f"^(?:(?:{'|'.join(T.POLITE)}) )?(?:{'|'.join(T.REQUESTS)})(?: (?:{'|'.join(T.NOTHING)}))?$"
_GREET = ", ".join(f"'{w}'" for w in T.GREETINGS)


@query(
    f"""SELECT session, turn, (p IN ({_GREET}) OR (turn % 3 <> 0 AND ((p <> '' AND len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '' AND NOT list_contains([{_WORDS}], w))) = 0) OR regexp_matches(p, '{_BARE}')))) AS vague
FROM (SELECT session, turn, trim(regexp_replace(lower(q), '[^a-z0-9_ ]', '', 'g')) AS p FROM (SELECT session, turn, CASE WHEN session % 4 = 0 THEN 'Hello!' WHEN session % 4 = 1 THEN 'What is this about?' WHEN session % 4 = 2 THEN 'Explain: revenue' WHEN turn % 2 = 0 THEN 'Could you talk about my files?' ELSE '' END AS q FROM {_MSG}))"""
)
def vague_query_guard(spark, d):
    s = F.col("session") % 4
    q = F.when(s == 0, "Hello!").when(s == 1, "What is this about?").when(s == 2, "Explain: revenue").when(F.col("turn") % 2 == 0, "Could you talk about my files?").otherwise("")
    return Vault(spark, d).messages().select("session", "turn", T.needs_clarification(q, F.col("turn") % 3 == 0).alias("vague"))


@query(
    r"""WITH m AS (SELECT conv_id AS session, turn, 'See [[chunk:' || conv_id || ']] and [[chunk:a], [chunk: b ]]' || text AS t FROM conversations WHERE role = 'assistant'),
s AS (SELECT session, turn, [{'k': 'text', 'b': 'See '}, {'k': 'citation', 'b': session::VARCHAR}, {'k': 'text', 'b': ' and '}, {'k': 'citation', 'b': 'a'}, {'k': 'citation', 'b': 'b'}, {'k': 'text', 'b': text}] AS p FROM (SELECT conv_id AS session, turn, text FROM conversations WHERE role = 'assistant'))
SELECT session, turn, pos::INT AS pos, p[pos + 1].k AS kind, p[pos + 1].b AS body FROM (SELECT *, unnest(range(0, 6)) AS pos FROM s)"""
)
def answer_segments(spark, d):
    rows = Vault(spark, d).messages().where("role = 'assistant'")
    text = F.concat(F.lit("See [[chunk:"), F.col("session").cast("string"), F.lit("]] and [[chunk:a], [chunk: b ]]"), "content")
    return C.answer_segments(rows.select("session", "turn", text.alias("content")))


@query(
    f"""WITH c AS (SELECT id // 10 AS qid, id AS chunk, user_id AS document, text AS content, id % 10 AS position FROM {DOCS_SQL} WHERE status = 'ready'),
g AS (SELECT qid, document, min(position) AS first, string_agg('[[chunk:' || chunk || ']]' || chr(10) || content, chr(10) || chr(10) ORDER BY position) AS blocks FROM c GROUP BY qid, document)
SELECT qid, 'Answer from the sources.' || chr(10) || chr(10) || string_agg('### Source: "' || CASE WHEN document = 'src0' THEN 'Untitled document' ELSE upper(document) END || '"' || chr(10) || blocks, chr(10) || chr(10) ORDER BY first) AS prompt FROM g GROUP BY qid"""
)
def instructions(spark, d):
    docs = Vault(spark, d).searchable()
    chunks = docs.select(F.expr("id div 10").alias("qid"), (F.col("id") % 10).alias("position"), F.col("id").alias("chunk"), F.col("user_id").alias("document"), F.col("text").alias("content"))
    titles = docs.select(F.col("user_id").alias("document"), F.upper("user_id").alias("title")).where("document <> 'src0'").distinct()
    return C.instructions(chunks, titles, "Answer from the sources.")


@query(f"SELECT id AS document, 0 AS place, 'Do ' || id AS title, '' AS description, id::VARCHAR AS chunk FROM {DOCS_SQL} WHERE id % 4 < 2")
def action_items(spark, d):
    """Items of answers in code fences or prose; of remainder 2 the chunk is another document's, of remainder 3 the JSON is cut off."""
    i = F.col("id").cast("string")
    k = F.col("id") % 4
    item = F.concat(F.lit('{"items": [{"title": "Do '), i, F.lit('", "source_chunk_id": "'), F.when(k == 2, "none").otherwise(i), F.lit('"}, {"title": "", "source_chunk_id": "'), i, F.lit('"}]}'))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(k == 3, F.substring(item, 1, 20)).otherwise(F.concat(F.lit("Here: "), item, F.lit(" done")))
    docs = Vault(spark, d).documents()
    return C.action_items(docs.select(F.col("id").alias("document"), raw.alias("raw")), docs.select(F.col("id").alias("document"), F.col("id").alias("chunk")))


@query("SELECT conv_id AS session, turn, CASE WHEN turn % 4 = 0 THEN nullif(text, '') END AS delta FROM conversations")
def sse_text(spark, d):
    k = F.col("turn") % 4
    event = lambda kind: F.to_json(F.struct(F.lit(kind).alias("event_type"), F.struct(F.lit("text").alias("type"), F.col("content").alias("text")).alias("delta")))
    line = F.when(k == 0, F.concat(F.lit("data: "), event("step.delta"))).when(k == 1, "data: [DONE]").when(k == 2, F.concat(F.lit("data:"), event("step.end"))).otherwise(F.concat(F.lit("event: "), event("step.delta")))
    return Vault(spark, d).messages().select("session", "turn", C.sse_text(line).alias("delta"))


@query(
    f"""WITH {_CITED}, n AS (SELECT session, chunk, row_number() OVER (PARTITION BY session ORDER BY seen) AS number FROM (SELECT session, chunk, min({{'turn': turn, 'place': place}}) AS seen FROM cited GROUP BY ALL)),
f AS (SELECT session, string_agg('[' || number || ']: ' || CASE WHEN chunk = '4' THEN 'Four' ELSE 'Untitled document' END, chr(10) ORDER BY number) AS foot FROM n GROUP BY session),
placed AS (SELECT session, turn, max(CASE WHEN chunk = (session % 97)::VARCHAR THEN number END) AS a, max(CASE WHEN chunk = (turn + 3)::VARCHAR THEN number END) AS b, max(CASE WHEN chunk = ((session + turn) % 89)::VARCHAR THEN number END) AS c FROM (SELECT session, turn FROM {_MSG} WHERE role = 'assistant') JOIN n USING (session) GROUP BY session, turn),
said AS (SELECT session, turn, '## Assistant' || chr(10) || 'see [' || a || '] and [' || b || '][' || a || ']' || CASE WHEN turn % 2 = 0 THEN '' ELSE ' [' || c || ']' END || chr(10) AS t FROM placed UNION ALL
  SELECT session, turn, '## ' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || chr(10) || regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '') || chr(10) FROM {_MSG} WHERE role <> 'assistant')
SELECT session, '# Chat' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY turn) || coalesce(chr(10) || '---' || chr(10) || chr(10) || '**Sources**' || chr(10) || chr(10) || any_value(foot), '') AS markdown FROM said LEFT JOIN f USING (session) GROUP BY session"""
)
def export_markdown(spark, d):
    rows = _marked(spark, d)
    titles = rows.sparkSession.createDataFrame([("4", "Four")], "chunk string, title string")
    return C.export_markdown(rows, _cited(spark, d), titles)


@query(
    f"""WITH {_CITED}, t AS (SELECT session, turn, max(content) AS content FROM {_MSG} WHERE role = 'assistant' GROUP BY ALL),
k AS (SELECT session, turn, string_agg(chunk, ',' ORDER BY place) AS cited, count(*) AS n FROM cited GROUP BY ALL)
SELECT session::VARCHAR AS session, turn, coalesce(content, '') AS text, (session % 97) || ',' || (turn + 3) || ',' || ((session + turn) % 89) AS chunks, CASE WHEN content IS NULL THEN '' ELSE coalesce(cited, '') END AS cited,
(2 + CASE WHEN content IS NULL THEN 0 ELSE len(regexp_extract_all(content, '[^ ]+ *|^ +')) + coalesce(n, 0) END)::INT AS n_events, CASE WHEN content IS NULL THEN 'error' ELSE 'done' END AS outcome, true AS whole FROM t LEFT JOIN k USING (session, turn)"""
)
def event_stream(spark, d):
    """Every answer as an event stream, written by a stream and put together again from its files."""
    s, t = F.col("session"), F.col("turn")
    said = Vault(spark, d).messages().where("role = 'assistant'").groupBy("session", "turn").agg(F.max("content").alias("content"))
    cited = _cited(spark, d).distinct().groupBy("session", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk"))), lambda c: c["chunk"]).alias("cited"))
    chunks = F.array((s % 97).cast("string"), (t + 3).cast("string"), ((s + t) % 89).cast("string"))
    turns = said.join(cited, ["session", "turn"], "left").withColumn("chunks", chunks)
    root = new_path(spark, "events")
    turns.write.parquet(f"{root}/turns")
    events.write_events(events.turn_events(spark.readStream.schema(turns.schema).parquet(f"{root}/turns")), f"{root}/out", f"{root}/state")
    listed = lambda c: F.array_join(c, ",").alias(c)
    return events.answers(events.read_events(spark, f"{root}/out")).select("session", "turn", "text", listed("chunks"), listed("cited"), "n_events", "outcome", "whole")
