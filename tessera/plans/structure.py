"""Queries on the structure of texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.operators import structure as S
from tessera.plans.layout import REGIONS_SQL
from tessera.plans.registry import query
from tessera.sources.vault import DOCS_SQL, Vault, table

# Every document as Markdown: a title, and a blank line for each line break.
_MD_TEXT = "'# Document ' || id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))"
_BLOCKS = f"""m AS (SELECT id, {_MD_TEXT} AS t FROM {DOCS_SQL} WHERE text IS NOT NULL),
a AS (SELECT id, string_split_regex(t, '\\n\\s*\\n') AS parts, list_concat(regexp_extract_all(t, '(\\n\\s*\\n)', 1), ['']) AS gaps FROM m),
u AS (SELECT id, unnest(parts) AS part, unnest(gaps) AS gap, generate_subscripts(parts, 1) AS nth FROM a),
s AS (SELECT *, coalesce(sum(length(part) + length(gap)) OVER (PARTITION BY id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(part) - length(regexp_replace(part, '^\\s+', '')) AS text_start,
  regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS content FROM u),
b AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY nth) - 1)::INT AS ordinal, text_start::BIGINT AS text_start, (text_start + length(content))::BIGINT AS text_end, content FROM s WHERE content <> '')"""


def _markdown(spark, d):
    text = F.concat(F.lit("# Document "), F.col("id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return Vault(spark, d).documents().where(F.col("text").isNotNull()).select("id", text.alias("text"))


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def text_blocks(spark, d):
    return S.text_blocks(_markdown(spark, d)).select("id", F.col("ordinal").cast("int").alias("ordinal"), F.col("text_start").cast("long").alias("text_start"), F.col("text_end").cast("long").alias("text_end"), "content")


@query(
    f"""WITH {_BLOCKS}, r AS (SELECT id, ordinal, regexp_matches(content, '^(#{{1,6}})\\s+(.+?)\\s*$') AS head, content,
len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(?:[-*+] |\\d+[.)] )'))) = 0 AS items FROM b)
SELECT id, ordinal, CASE WHEN head THEN 'heading' WHEN starts_with(content, '```') THEN 'code' WHEN items THEN 'list' ELSE 'paragraph' END AS region_type,
CASE WHEN head THEN length(regexp_extract(content, '^(#{{1,6}})\\s+(.+?)\\s*$', 1))::INT END AS heading_level, CASE WHEN head THEN regexp_extract(content, '^(#{{1,6}})\\s+(.+?)\\s*$', 2) ELSE content END AS content FROM r"""
)
def markdown_regions(spark, d):
    rows = S.markdown_regions(_markdown(spark, d))
    return rows.select("id", F.col("ordinal").cast("int").alias("ordinal"), "region_type", F.col("heading_level").cast("int").alias("heading_level"), "content")


# All words of all documents laid on pages of 50 lines of ten, every seventh line in large type.
_PLACED = f"""w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS ws FROM {DOCS_SQL})),
q AS (SELECT id, i // 500 AS page, (i // 10 % 50)::INT AS line, i % 10 AS nth, word, (i % 10) * 60.0 AS x0, (i // 10 % 50) * 20.0 + i % 3 AS top FROM w),
l AS (SELECT id, page, line, string_agg(word, ' ' ORDER BY nth) AS content, min(x0) AS x0, max(x0) + 50 AS x1, min(top) AS top, max(top) + 10 AS bottom, CASE WHEN line % 7 = 0 THEN 20.0 ELSE 10.0 END AS size, count(*) AS n FROM q GROUP BY id, page, line),
md AS (SELECT id, page, median(CASE WHEN line % 7 = 0 THEN 20.0 ELSE 10.0 END) AS typical FROM q GROUP BY id, page),
k AS (SELECT l.*, CASE WHEN regexp_matches(content, '(?i)^(figure|fig\\.|table)\\s+\\d+') THEN 'caption' WHEN top > 860 AND size < typical * 0.9 THEN 'footnote' WHEN size >= typical * 1.25 AND length(content) <= 160 THEN 'heading' ELSE 'paragraph' END AS region_type FROM l JOIN md USING (id, page))"""


def _lines(spark, d):
    words = F.filter(F.split("text", "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")
    rows = Vault(spark, d).documents().select("id", F.posexplode(words).alias("i", "text"))
    page, line = F.expr("i div 500"), F.expr("(i div 10) % 50")
    x0, top = (F.col("i") % 10) * F.lit(60.0), line * F.lit(20.0) + F.col("i") % 3
    size = F.when(line % 7 == 0, 20.0).otherwise(10.0)
    placed = rows.select(F.concat_ws("/", "id", page).alias("page"), "text", x0.alias("x0"), top.alias("top"), (x0 + 50).alias("x1"), (top + 10).alias("bottom"), size.alias("size"), F.lit(612.0).alias("width"), F.lit(1000.0).alias("height"))
    return S.page_lines(placed)


@query(f"WITH {_PLACED} SELECT id || '/' || page AS page, line, content, round(top / 1000, 6) AS top, round(least(1, x1 / 612), 6) AS x1, region_type FROM k")
def page_lines(spark, d):
    rows = _lines(spark, d)
    return rows.select("page", "line", "content", F.round("top", 6).alias("top"), F.round("x1", 6).alias("x1"), "region_type")


_PAGE_BLOCKS = f"""WITH {_PLACED}, o AS (SELECT *, CASE WHEN region_type = 'paragraph' AND lag(region_type) OVER p = 'paragraph' THEN 0 ELSE 1 END AS new FROM k WINDOW p AS (PARTITION BY id, page ORDER BY line)),
g AS (SELECT *, sum(new) OVER (PARTITION BY id, page ORDER BY line) - 1 AS block FROM o),
bl AS (SELECT id || '/' || page AS page, block::INT AS block, string_agg(content, ' ' ORDER BY line) AS content, min(line) AS line FROM g GROUP BY id, page, block)"""


@query(_PAGE_BLOCKS + " SELECT page, block, content FROM bl")
def page_blocks(spark, d):
    return S.page_blocks(_lines(spark, d)).select("page", "block", "content")


_BOXES = """x AS (SELECT doc_id // 10 AS page, (doc_id % 10)::INT AS block, CASE WHEN doc_id // 10 % 3 = 0 THEN 0.05 WHEN doc_id % 10 IN (0, 7) THEN 0.05 WHEN doc_id % 2 = 0 THEN 0.08 ELSE 0.53 END AS x0,
CASE WHEN doc_id // 10 % 3 = 0 THEN 0.95 WHEN doc_id % 10 IN (0, 7) THEN 0.95 WHEN doc_id % 2 = 0 THEN 0.47 ELSE 0.92 END AS x1, (n_chars % 97) / 100.0 AS top FROM documents)"""


@query(
    f"""WITH {_BOXES}, f AS (SELECT *, x1 - x0 < 0.55 AS narrow FROM x), c AS (SELECT *, bool_or(narrow AND x1 <= 0.58) OVER p AND bool_or(narrow AND x0 >= 0.42) OVER p AND count(*) OVER p > 1 AS two FROM f WINDOW p AS (PARTITION BY page))
SELECT page, block, (row_number() OVER (PARTITION BY page ORDER BY CASE WHEN NOT two OR NOT narrow THEN 0 WHEN (x0 + x1) / 2 < 0.5 THEN 1 ELSE 2 END, top, CASE WHEN two THEN 0 ELSE x0 END, block) - 1)::INT AS reading_order FROM c"""
)
def reading_order(spark, d):
    i, full = F.col("doc_id"), F.expr("doc_id div 10") % 3 == 0
    wide, even = F.col("block").isin(0, 7), i % 2 == 0
    rows = table(spark, d, "documents").select(i, F.expr("doc_id div 10").alias("page"), (i % 10).cast("int").alias("block"), ((F.col("n_chars") % 97) / 100).alias("top"))
    rows = rows.withColumns({"x0": F.when(full | wide, 0.05).when(even, 0.08).otherwise(0.53), "x1": F.when(full | wide, 0.95).when(even, 0.47).otherwise(0.92)})
    return S.reading_order(rows).select("page", "block", "reading_order")


# One payload a page: pages of remainder 1 name a region that is not there, of remainder 2 a bad type, of remainder 3 are no JSON.
@query(
    "WITH "
    + REGIONS_SQL
    + """, w AS (SELECT page_id, ordinal, region_type, CASE WHEN ordinal % 4 = 2 THEN '' ELSE content END AS content FROM g)
SELECT page_id, ordinal, CASE WHEN ok THEN 'chart' ELSE region_type END AS region_type, CASE WHEN ok AND content = '' THEN 'seen' ELSE content END AS content, CASE WHEN ok THEN 'about it' END AS summary, CASE WHEN ok THEN '0.1,0.2,0.3,0.9' END AS box, CASE WHEN NOT ok THEN 'local' WHEN content = '' THEN 'vision' ELSE 'merged' END AS source
FROM (SELECT *, page_id % 5 IN (0, 4) AND ordinal IN (0, 2) AS ok FROM w)"""
)
def merge_vision(spark, d):
    regions = L.html_regions(table(spark, d, "pages")).withColumn("content", F.when(F.col("ordinal") % 4 == 2, "").otherwise(F.col("content")))
    there = regions.groupBy("page_id").agg(F.collect_set("ordinal").alias("ordinals"))
    item = lambda at, kind: F.concat(F.lit('{"local_ordinal": '), at.cast("string"), F.lit(f', "type": "{kind}", "bbox": [900, 100, 200, 300], "content": " seen ", "summary": "about it"}}'))
    wanted = F.array_sort(F.array_intersect("ordinals", F.array(F.lit(0), F.lit(2))))
    k = F.col("page_id") % 5
    items = F.concat(F.transform(wanted, lambda o: item(o, "chart")), F.when(k == 1, F.array(item(F.lit(9999), "chart"))).when(k == 2, F.array(item(F.lit(0), "poem"))).otherwise(F.array().cast("array<string>")))
    payload = F.when(k == 3, "no JSON").otherwise(F.concat(F.lit('{"regions": ['), F.array_join(items, ", "), F.lit("]}")))
    out = S.merge_vision(regions.select("page_id", "ordinal", "region_type", "content"), there.select("page_id", payload.alias("payload")))
    return out.select("page_id", "ordinal", "region_type", "content", "summary", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("box"), "source")


@query("SELECT document, surface FROM (SELECT document, surface, row_number() OVER (PARTITION BY document ORDER BY surface) AS n FROM (SELECT user_id AS document, event_id AS surface FROM events WHERE event_type <> 'click' AND event_id % 5 <> 0)) WHERE n <= 4")
def surfaces_to_enrich(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("surface"), (F.col("event_type") != "click").alias("complex"), (F.col("event_id") % 5 == 0).alias("enriched"))
    return S.surfaces_to_enrich(rows, 4).select("document", "surface")
