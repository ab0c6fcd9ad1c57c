"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import ann
from tessera.operators import layout as L
from tessera.operators import postings as P
from tessera.operators import retrieval as R
from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.sources.scratch import new_path
from tessera.sources.vault import DOCS_SQL, VECTORS_SQL, Vault, table

_TOKENS = r"regexp_extract_all(lower(text), '(\p{L}+)', 1)"
_NEAR = "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT id, user_id, lang, size FROM {DOCS_SQL} WHERE status = 'ready' AND lang IN ('en', 'de') AND size < 5000")
def scan_filter_project(spark, d):
    return Vault(spark, d).documents().where((F.col("status") == "ready") & F.col("lang").isin("en", "de") & (F.col("size") < 5000)).select("id", "user_id", "lang", "size")


@query(f"SELECT id, status FROM {DOCS_SQL} WHERE user_id = 'src3'")
def tenant_documents(spark, d):
    return Vault(spark, d, "src3").documents().select("id", "status")


@query("SELECT e.vec_id AS id, round(" + _NEAR + ", 6) AS distance FROM " + VECTORS_SQL + " e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY " + _NEAR + ", e.vec_id LIMIT 20")
def vector_topk(spark, d):
    v = Vault(spark, d).vectors()
    q = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    distance = V.cosine_distance(F.col("embedding"), F.col("q"))
    return v.crossJoin(F.broadcast(q)).select("id", distance.alias("x")).orderBy("x", "id").limit(20).select("id", F.round("x", 6).alias("distance"))  # one row


def _asked(spark, d):
    """Questions' vectors: a twentieth of all rows."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(
    f"""SELECT qid, id, rank, round(distance, 6) AS distance FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_NEAR} AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_NEAR}, 9), e.vec_id) AS rank FROM {VECTORS_SQL} e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
    rank="rank",
)
def vector_topk_batch(spark, d):
    v = Vault(spark, d).vectors()
    near = R.nearest(v, _asked(spark, d), 20)
    return near.select("qid", "id", "rank", F.round("distance", 6).alias("distance"))


@query(
    f"""SELECT qid, id, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_NEAR}, 9), e.vec_id) AS rank
FROM embeddings e JOIN {DOCS_SQL} x ON x.id = e.vec_id, embeddings q WHERE q.vec_id % 20 = 0 AND x.status = 'ready' AND x.provider = 'p1') WHERE rank <= 20""",
    rank="rank",
)
def vector_by_provider(spark, d):
    vault = Vault(spark, d)
    v = vault.vectors()
    own = v.join(vault.searchable().where("provider = 'p1'").select("id"), "id")
    return R.nearest(own, _asked(spark, d), 20).select("qid", "id", "rank")


@query()
def vector_topk_ann(spark, d):
    """vector_topk_batch() by the approximate index; tests measure how many of its rows are found."""
    v = Vault(spark, d).vectors()
    index = ann.build_index(v, new_path(spark, "vectors"))
    return index.search(v, _asked(spark, d), 20).select("qid", "id", "rank", F.round("distance", 6).alias("distance"))


def _tf(term: str) -> str:
    return f"len(list_filter({_TOKENS}, lambda t: t = '{term}'))"


def _fts(where: str, terms: list[str]) -> str:
    score = " + ".join(f"ln(1 + {_tf(t)})" for t in terms)
    return f"SELECT id, round({score}, 6) AS score FROM {DOCS_SQL} WHERE status = 'ready' AND ({where}) ORDER BY round({score}, 9) DESC, id LIMIT 20"


def _searched(spark, d, match, terms):
    docs = Vault(spark, d).searchable()
    counts = {t: T.term_count(F.col("text"), t) for t in terms}
    score = sum((F.log1p(c) for c in counts.values()), F.lit(0.0))
    return docs.where(match(counts, docs)).select("id", F.round(score, 9).alias("x")).orderBy(F.col("x").desc(), "id").limit(20).select("id", F.round("x", 6).alias("score"))


@query(_fts(f"{_tf('with')} > 0 AND {_tf('from')} > 0", ["with", "from"]))
def fts_and(spark, d):
    return _searched(spark, d, lambda c, _: (c["with"] > 0) & (c["from"] > 0), ["with", "from"])


@query(_fts(f"{_tf('avec')} > 0 OR {_tf('nicht')} > 0", ["avec", "nicht"]))
def fts_or(spark, d):
    return _searched(spark, d, lambda c, _: (c["avec"] > 0) | (c["nicht"] > 0), ["avec", "nicht"])


@query(_fts(f"{_tf('with')} > 0 AND {_tf('the')} = 0", ["with"]))
def fts_negation(spark, d):
    return _searched(spark, d, lambda c, x: (c["with"] > 0) & (T.term_count(x["text"], "the") == 0), ["with"])


@query(f"SELECT id, status FROM {DOCS_SQL} WHERE status = 'ready' AND (' ' || array_to_string({_TOKENS}, ' ') || ' ') LIKE '% of the %'")
def fts_phrase(spark, d):
    return Vault(spark, d).searchable().where(F.lower("text").rlike(T.phrase_pattern(["of", "the"]))).select("id", "status")


# --- hybrid ---------------------------------------------------------------------------------------------------------

_HYBRID_SQL = f"""
WITH docs AS (SELECT * FROM {DOCS_SQL} WHERE status = 'ready'),
tok AS (SELECT id, unnest({_TOKENS}) AS term FROM docs),
words AS MATERIALIZED (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark),
parts AS (SELECT item_id AS qid, unnest(string_split_regex(' ' || replace(text, ' ', '  ') || ' ', '\\s[oO][rR]\\s')) AS text FROM benchmark),
alts AS MATERIALIZED (SELECT qid, row_number() OVER () AS alt, list_distinct({_TOKENS}) AS ws FROM parts),
need AS MATERIALIZED (SELECT qid, alt, len(ws) AS n, unnest(ws) AS term FROM alts),
terms AS (SELECT DISTINCT qid, term FROM need),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM words) GROUP BY id, term),
fit AS (SELECT DISTINCT qid, id FROM (SELECT qid, alt, id FROM tf JOIN need USING (term) GROUP BY qid, alt, id HAVING count(*) = min(n))),
lexs AS (SELECT qid, id, round(sum(ln(1 + tf)), 9) AS score FROM tf JOIN terms USING (term) SEMI JOIN fit USING (qid, id) GROUP BY qid, id),
share AS (SELECT qid, id, count(*) AS hits FROM tf JOIN words USING (term) GROUP BY qid, id),
lex AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lexs) WHERE rank <= 20),
vecs AS (SELECT q.vec_id AS qid, e.vec_id AS id, {_NEAR} AS distance FROM embeddings e JOIN docs x ON x.id = e.vec_id, (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q),
vec AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM vecs) WHERE rank <= 20),
legs AS (SELECT qid, id, rank, 0 AS leg FROM vec UNION ALL SELECT qid, id, rank, 1 FROM lex),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(leg * 1000 + rank) AS seen FROM legs GROUP BY qid, id),
ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS position FROM fused)
"""


def _legs(spark, d):
    vault = Vault(spark, d)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs, v = vault.searchable(), vault.vectors()
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding").join(questions.select("qid"), "qid")
    near = R.nearest(v, asked, R.LEG).select("qid", "id", "rank")
    return docs, questions, near, S.best_matches(docs, questions, R.LEG).select("qid", "id", "rank")


@query(_HYBRID_SQL + "SELECT qid, id, round(score, 9) AS score, position FROM ranked WHERE position <= 10", rank="position")
def rrf_fuse(spark, d):
    *_, near, lex = _legs(spark, d)
    return R.rrf([near, lex]).where("position <= 10").select("qid", "id", F.round("score", 9).alias("score"), "position")


_BOOSTED = """, boosted AS (SELECT qid, id, leg, row_number() OVER (PARTITION BY qid, leg ORDER BY CASE WHEN qid % 2 = 0 AND id % 30 + 1 = qid % 30 + 1 THEN 0 ELSE 1 END, rank) AS rank FROM legs),
bf AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(leg * 1000 + rank) AS seen FROM boosted GROUP BY qid, id)
SELECT qid, id, position FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS position FROM bf) WHERE position <= 10"""


@query(_HYBRID_SQL + _BOOSTED, rank="position")
def page_boost_rrf(spark, d):
    *_, near, lex = _legs(spark, d)
    asked = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("what is on page "), (F.col("qid") % 30 + 1).cast("string"), F.lit("?"))).otherwise("what is there?")
    boosted = [R.page_boost(leg, F.col("id") % 30 + 1, T.explicit_page(asked)) for leg in (near, lex)]
    return R.rrf(boosted).where("position <= 10").select("qid", "id", "position")


@query(
    _HYBRID_SQL
    + """, one AS (SELECT qid, id, position, row_number() OVER (PARTITION BY qid, CASE WHEN id % 5 = 0 THEN 'i' || id ELSE 'r' || (id // 3) END ORDER BY position) AS n FROM ranked)
SELECT qid, id, position FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY position) AS position FROM one WHERE n = 1) WHERE position <= 10""",
    rank="position",
)
def region_dedupe(spark, d):
    *_, near, lex = _legs(spark, d)
    region = F.when(F.col("id") % 5 != 0, F.floor(F.col("id") / 3))
    return R.dedupe_regions(R.rrf([near, lex]), region).where("position <= 10").select("qid", "id", "position")


@query(
    _HYBRID_SQL
    + """, of AS (SELECT qid, r.id, position, user_id FROM ranked r JOIN docs x ON x.id = r.id),
late AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, user_id ORDER BY position) <= 3 THEN 0 ELSE 1 END AS late FROM of)
SELECT qid, id, final FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY late, position) AS final FROM late) WHERE final <= 5""",
    rank="final",
)
def diversity_select(spark, d):
    docs, *_, near, lex = _legs(spark, d)
    ranked = R.rrf([near, lex]).join(docs.select("id", "user_id"), "id")
    return R.diversify(ranked, "user_id").select("qid", "id", "final")


@query(
    _HYBRID_SQL
    + """, nt AS (SELECT qid, count(*) AS n FROM words GROUP BY qid),
top AS (SELECT r.qid, r.id, r.position, coalesce(hits::DOUBLE / n, 0) AS relevance, user_id FROM ranked r JOIN docs x ON x.id = r.id JOIN nt USING (qid) LEFT JOIN share l ON l.qid = r.qid AND l.id = r.id WHERE position <= 10),
good AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, position) AS p2 FROM top WHERE relevance >= 0.2),
late AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, user_id ORDER BY p2) <= 3 THEN 0 ELSE 1 END AS late FROM good)
SELECT qid, id, round(relevance, 6) AS relevance, final FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY late, p2) AS final FROM late) WHERE final <= 5""",
    rank="final",
)
def hybrid_search(spark, d):
    """Both legs, fusion, ten candidates, relevance with its floor, then five with at most three of a source."""
    docs, questions, near, lex = _legs(spark, d)
    owner = docs.select("id", F.col("user_id").alias("document"))
    return R.retrieve([near, lex], owner, R.overlap(docs, questions), require_relevance=True).select("qid", "id", F.round("relevance", 6).alias("relevance"), "final")


_VISUAL = "id % 4 < 2 AND id % 3 = 0"
_EVIDENCE_SQL = f""", chunk AS MATERIALIZED (SELECT id, user_id AS document, id % 30 + 1 AS page, CASE WHEN id % 5 > 0 THEN id // 3 END AS region, CASE id % 4 WHEN 0 THEN 'chart' WHEN 1 THEN 'image' ELSE 'paragraph' END AS kind,
  CASE WHEN {_VISUAL} THEN '' ELSE text END AS content, text FROM docs),
bl AS (SELECT qid, l.id, leg, row_number() OVER (PARTITION BY qid, leg ORDER BY CASE WHEN qid % 2 = 0 AND page = qid % 30 + 1 THEN 0 ELSE 1 END, rank) AS rank FROM legs l JOIN chunk c ON c.id = l.id),
bf AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(leg * 1000 + rank) AS seen FROM bl GROUP BY qid, id),
once AS (SELECT qid, bf.id, score, seen, row_number() OVER (PARTITION BY qid, coalesce('r' || region, 'i' || bf.id) ORDER BY score DESC, seen) AS n FROM bf JOIN chunk c ON c.id = bf.id),
cand AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS position FROM once WHERE n = 1) WHERE position <= 10),
t0 AS (SELECT qid, position, c.*, region IS NOT NULL AND kind <> 'paragraph' AND trim(coalesce(content, '')) = '' AS blank FROM cand JOIN chunk c USING (id)),
t1 AS (SELECT * REPLACE (CASE WHEN blank AND row_number() OVER (PARTITION BY qid, blank ORDER BY position) <= 4 THEN coalesce(t.caption, content) ELSE content END AS content)
  FROM t0 LEFT JOIN (SELECT region AS r, 'shows ' || arg_min(left(text, 80), id) AS caption FROM chunk WHERE region IS NOT NULL AND text IS NOT NULL GROUP BY region) t ON t.r = t0.region),
t2 AS (SELECT t1.qid, t1.position, t1.id, t1.document, t1.page, t1.region, t1.kind, CASE WHEN x.id IS NULL AND y.id IS NULL THEN t1.content ELSE concat_ws(chr(10) || chr(10), nullif(t1.content, ''),
  CASE WHEN x.text <> '' AND x.text IS DISTINCT FROM t1.content THEN x.text END, CASE WHEN y.text <> '' AND y.text IS DISTINCT FROM t1.content AND y.text IS DISTINCT FROM x.text THEN y.text END) END AS content
  FROM t1 LEFT JOIN docs x ON x.id = region * 3 - 1 LEFT JOIN docs y ON y.id = region * 3 + 3),
t3 AS (SELECT * REPLACE (CASE WHEN trim(coalesce(content, '')) = '' THEN coalesce(k.caption, content) ELSE content END AS content) FROM t2 LEFT JOIN (SELECT user_id AS u, min(left(text, 60)) AS caption FROM docs GROUP BY user_id) k ON k.u = t2.document),
t4 AS (SELECT *, CASE WHEN region IS NOT NULL THEN 'Document: Untitled' || chr(10) || 'Heading: Root' || chr(10) || 'Page: ' || page || chr(10) || 'Region: ' || kind || chr(10) || 'Content: ' || coalesce(content, '') ELSE content END AS text FROM t3),
qw AS (SELECT qid, list(term) AS ws FROM words GROUP BY qid),
t5 AS (SELECT *, coalesce(len(list_filter(ws, lambda w: list_contains({_TOKENS}, w)))::DOUBLE / len(ws), 0) AS relevance FROM t4 LEFT JOIN qw USING (qid)),
t6 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, position) AS p2 FROM t5 WHERE relevance >= 0.2),
t7 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, document ORDER BY p2) <= 3 THEN 0 ELSE 1 END AS late FROM t6)
SELECT qid, id, document, round(relevance, 6) AS relevance, final, length(content) AS length, md5(content) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY late, p2) AS final FROM t7) WHERE final <= 5"""


@query(_HYBRID_SQL + _EVIDENCE_SQL, rank="final")
def retrieve_evidence(spark, d):
    """hybrid_search with all that is known of regions: pages asked for first, one chunk a region, descriptions of visual regions, what stands around, captions."""
    docs, questions, near, lex = _legs(spark, d)
    i = F.col("id")
    region, visual = F.when(i % 5 > 0, F.expr("id div 3")), F.expr(_VISUAL)
    chunks = docs.select("id", F.col("user_id").alias("document"), (i % 30 + 1).alias("page"), region.alias("region"), F.when(i % 4 == 0, "chart").when(i % 4 == 1, "image").otherwise("paragraph").alias("region_type"), F.when(visual, "").otherwise(F.col("text")).alias("content"))
    asked = questions.where("qid % 2 = 0").select("qid", T.explicit_page(F.concat(F.lit("what is on page "), (F.col("qid") % 30 + 1).cast("string"))).alias("page"))
    near_by = F.explode(F.array(F.struct(F.expr("(id + 1) div 3").alias("region"), F.lit(0).alias("position"), ((i + 1) % 3 == 0).alias("at")), F.struct(F.expr("id div 3 - 1").alias("region"), F.lit(1).alias("position"), (i % 3 == 0).alias("at"))))
    context = docs.select("text", near_by.alias("n")).where("n.at").select("n.region", "n.position", F.col("text").alias("content"))

    def describe(regions):
        held = docs.where(region.isNotNull() & F.col("text").isNotNull()).select(region.alias("region"), "id", F.substring("text", 1, 80).alias("said"))
        return held.join(regions, "region", "left_semi").groupBy("region").agg(F.concat(F.lit("shows "), F.min_by("said", "id")).alias("caption"))

    captions = docs.groupBy(F.col("user_id").alias("document")).agg(F.min(F.substring("text", 1, 60)).alias("caption"))
    found = R.retrieve([near, lex], R.Evidence(chunks, asked, describe, context, captions), R.overlap_with_evidence(questions), require_relevance=True)
    return found.select("qid", "id", "document", F.round("relevance", 6).alias("relevance"), "final", F.length("content").cast("long").alias("length"), F.md5("content").alias("digest"))


@query(
    _HYBRID_SQL
    + """, lr AS (SELECT qid, id, rank AS position FROM lex), of AS (SELECT 'no scorer' AS down, qid, id, position FROM ranked WHERE position <= 10 UNION ALL SELECT 'no vectors', qid, id, position FROM lr WHERE position <= 10 UNION ALL SELECT 'no words', qid, id, rank FROM vec WHERE rank <= 10),
late AS (SELECT down, qid, of.id, position, CASE WHEN row_number() OVER (PARTITION BY down, qid, user_id ORDER BY position) <= 3 THEN 0 ELSE 1 END AS late FROM of JOIN docs x ON x.id = of.id)
SELECT down, qid, id, final FROM (SELECT down, qid, id, row_number() OVER (PARTITION BY down, qid ORDER BY late, position) AS final FROM late) WHERE final <= 5
UNION ALL SELECT 'all but sealed', 0, id, 5 + row_number() OVER (ORDER BY id) FROM """
    + DOCS_SQL
    + " WHERE status = 'sealed' AND contains(lower(text), 'of the')",
    rank="final",
)
def degraded_search(spark, d):
    """What is left when the scorer, the vectors or both legs are down."""
    docs, *_, near, lex = _legs(spark, d)
    owner = docs.select("id", F.col("user_id").alias("document"))
    shut = Vault(spark, d).documents().where("status = 'sealed'").select("id", F.col("text").alias("content"), F.col("user_id").alias("document"))
    matches = R.sealed_matches(shut, "of the").join(shut.select("id", "document"), "id").withColumn("qid", F.lit(0).cast("long"))
    modes = {"no scorer": R.retrieve([near, lex], owner, None), "no vectors": R.retrieve([None, lex], owner, None), "no words": R.retrieve([near, None], owner, None), "all but sealed": R.retrieve([None, None], owner, None, sealed=matches)}
    out = None
    for name, rows in modes.items():
        part = rows.select(F.lit(name).alias("down"), "qid", "id", "final")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH s AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM {DOCS_SQL} WHERE status = 'ready'),
p AS (SELECT id, len(lines) AS n, lines, unnest(range(0, len(lines))) AS pos FROM s)
SELECT id, pos::INT AS pos, lines[pos + 1] AS line FROM p WHERE list_contains([round_even(i * (n - 1)::DOUBLE / greatest(1, least(n, 5) - 1), 0)::BIGINT FOR i IN range(0, least(n, 5))], pos)"""
)
def doc_scoped_overview(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = Vault(spark, d).searchable().select("id", F.posexplode(lines).alias("pos", "line"))
    return R.evenly_spaced(rows, "id", "pos").select("id", "pos", "line")


@query(f"SELECT id, id % 4 AS generation FROM {DOCS_SQL} WHERE status = 'ready' AND ((id % 3 > 0 AND id % 4 = id % 3) OR (id % 3 = 0 AND id % 4 IS NULL)) UNION ALL SELECT id, NULL FROM {DOCS_SQL} WHERE status = 'ready' AND id % 3 = 0 AND id % 7 = 0")
def generation_filter(spark, d):
    docs = Vault(spark, d).searchable()
    active = F.when(F.col("id") % 3 > 0, F.col("id") % 3)
    chunks = docs.select("id", active.alias("active"), (F.col("id") % 4).alias("generation")).unionByName(docs.where("id % 7 = 0").select("id", active.alias("active"), F.lit(None).cast("long").alias("generation")))
    return chunks.where((F.col("generation") == F.col("active")) | (F.col("active").isNull() & F.col("generation").isNull())).select("id", "generation")


@query(f"SELECT id, 1.0::DOUBLE AS score FROM {DOCS_SQL} WHERE status = 'sealed' AND contains(lower(text), 'of the')")
def sealed_phrase_search(spark, d):
    sealed = Vault(spark, d).documents().where("status = 'sealed'").select("id", F.col("text").alias("content"))
    return R.sealed_matches(sealed, "Of The")


@query("SELECT item_id AS qid, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 8 THEN true ELSE false END AS hypothetical FROM benchmark")
def hyde_gate(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.use_hypothetical(F.col("text")).alias("hypothetical"))


@query(f"SELECT id, 'Document: ' || CASE WHEN id % 5 = 0 THEN 'Untitled' ELSE left(text, 10) END || chr(10) || 'Heading: Root' || chr(10) || 'Page: ' || (id % 30) || chr(10) || 'Region: text' || chr(10) || 'Content: ' || coalesce(text, '') AS evidence FROM {DOCS_SQL} WHERE status = 'ready'")
def evidence_lines(spark, d):
    docs, none = Vault(spark, d).searchable(), F.lit(None).cast("string")
    title = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.substring("text", 1, 10))
    return docs.select("id", T.serialize_evidence(title, none, F.col("id") % 30, none, F.col("text")).alias("evidence"))


@query(_fts(f"({_tf('with')} > 0 AND {_tf('from')} > 0 AND {_tf('nicht')} = 0) OR ((' ' || array_to_string({_TOKENS}, ' ') || ' ') LIKE '% of the %' AND {_tf('and')} > 0)", ["with", "from", "of", "the", "and"]))
def websearch(spark, d):
    found = S.web_search(Vault(spark, d).searchable(), 'with From -nicht OR "of the" and')
    return found.select("id", F.round("score", 6).alias("score"))


@query(_HYBRID_SQL + " SELECT qid, id, round(score, 6) AS score FROM lexs")
def websearch_batch(spark, d):
    """Documents with all words of one of a question's alternatives, for all questions."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return S.matching(Vault(spark, d).searchable(), questions).select("qid", "id", F.round("score", 6).alias("score"))


@query(_HYBRID_SQL + " SELECT qid, id, round(score, 6) AS score, rank FROM lex JOIN lexs USING (qid, id)", rank="rank")
def index_topk(spark, d):
    """The twenty best documents of every question by a stored index, blocks that cannot hold one left out."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    index = P.build_index(Vault(spark, d).searchable(), new_path(spark, "index"))
    return P.top_matches(index, S.parsed(questions), R.LEG).select("qid", "id", F.round("score", 6).alias("score"), "rank")


_CLOSE = "CASE WHEN abs(x.pos - y.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5::DOUBLE - 2)) END"


@query(
    _HYBRID_SQL
    + f""", pos AS (SELECT id, term, pos FROM (SELECT id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT id, {_TOKENS} AS ts FROM docs)) SEMI JOIN terms USING (term)),
kind AS (SELECT qid, count(DISTINCT alt) = 1 AND count(DISTINCT term) > 1 AS together, count(DISTINCT term) AS n FROM need GROUP BY qid),
fp AS (SELECT f.qid, f.id, p.term, p.pos, together, n FROM fit f JOIN kind USING (qid) JOIN terms t ON t.qid = f.qid JOIN pos p ON p.id = f.id AND p.term = t.term),
near AS (SELECT x.qid, x.id, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt({_CLOSE})))) AS rank FROM fp x JOIN fp y ON x.qid = y.qid AND x.id = y.id AND x.term < y.term WHERE x.together GROUP BY x.qid, x.id),
single AS (SELECT qid, id, sum(0.1::DOUBLE / 1.64493406685 / n / (nth * nth)) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, id, term ORDER BY pos) AS nth FROM fp WHERE NOT together) GROUP BY qid, id)
SELECT qid, id, round(rank, 6) AS rank FROM (FROM near UNION ALL FROM single)"""
)
def fts_ranked(spark, d):
    """What fits each question, by how close its words stand."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return S.ranked_search(Vault(spark, d).searchable(), questions).select("qid", "id", F.round("rank", 6).alias("rank"))


@query()
def fts_english(spark, d):
    """The twenty best documents of each question by English stems, without stop words."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return S.ranked_search(Vault(spark, d).searchable(), questions, True, R.LEG).select("qid", "id", F.round("rank", 6).alias("rank"), "place")


@query(
    f"""WITH docs AS (SELECT id, user_id AS scope, {_TOKENS} AS held FROM {DOCS_SQL} WHERE status = 'ready'),
asked AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS scope, list_distinct({_TOKENS}) AS ws FROM benchmark),
pairs AS (SELECT qid, scope, id, coalesce(len(list_filter(ws, lambda w: list_contains(held, w)))::DOUBLE / nullif(len(ws), 0), 0) AS relevance FROM docs JOIN asked USING (scope))
SELECT qid, scope, id, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY relevance DESC, id) AS rank FROM pairs WHERE relevance >= 0.2) WHERE rank <= 5""",
    rank="rank",
)
def document_scoped(spark, d):
    """Each question within one source alone: its five most relevant rows above the floor."""
    docs = Vault(spark, d).searchable().select("id", "text", F.col("user_id").alias("scope"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"), "text")
    return R.scoped(docs, questions).select("qid", "scope", "id", F.round("relevance", 6).alias("relevance"), "rank")


@query(
    f"""SELECT page_id, a AS region, list_sort(list(DISTINCT b)) AS near FROM (SELECT doc_id // 10 AS page_id, doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 10 < 9 AND doc_id % 3 > 0 UNION ALL SELECT doc_id // 10, doc_id + 1, doc_id FROM documents WHERE doc_id % 10 < 9 AND doc_id % 3 > 0)
WHERE b IN (SELECT doc_id FROM documents) GROUP BY page_id, a""".replace("list_sort(list(DISTINCT b)) AS near", "array_to_string(list_sort(list(DISTINCT b)), ',') AS near")
)
def related_regions(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    links = docs.where((i % 10 < 9) & (i % 3 > 0)).select(i.alias("source"), (i + 1).alias("target"), F.lit("references").alias("relation"))
    regions = docs.select(i.alias("region"), F.expr("doc_id div 10").alias("page_id"))
    near = L.related(links, regions).groupBy("region").agg(F.array_sort(F.collect_set("other")).alias("near"))
    return near.select(F.expr("region div 10").alias("page_id"), "region", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))
