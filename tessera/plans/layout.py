"""Layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.plans.registry import query
from tessera.sources.vault import DOCS_SQL, Vault, table

# A page without scripts, styles and comments, whose tags are marks: 1 tag 2 where a region begins, 3 where any other block begins or one ends,
# 4 for what stands for a space; inline tags go. A region's text is what follows its first mark up to the next 1 or 3.
_BLOCK = "address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|header|hgroup|html|main|menu|nav|ol|pre|section|summary|ul|h[1-6]|p|li|table"
_MARKED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|$)|<script\b.*?(</script\s*>|$)|<style\b.*?(</style\s*>|$)|<template\b.*?(</template\s*>|$)', '', 'g'),"
    r" '(?i)<(h[1-6]|p|li|table)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '(?i)</?(br|hr|caption|thead|tbody|tfoot|tr|td|th)\b[^>]*>', chr(4), 'g'),"
    rf" '(?i)</?({_BLOCK})\b[^>]*>', chr(3), 'g'), '<(/?[A-Za-z]|[/!?])[^>]*(>|$)', '', 'g')"
)
_MARK = "chr(1) || '([A-Za-z0-9]+)' || chr(2) || '([^' || chr(1) || chr(3) || ']*)'"
REGIONS_SQL = f"""k AS (SELECT page_id, {_MARKED} AS m FROM pages),
x AS (SELECT page_id, unnest(list_zip(regexp_extract_all(m, {_MARK}, 1), regexp_extract_all(m, {_MARK}, 2))) AS r, generate_subscripts(regexp_extract_all(m, {_MARK}, 1), 1) AS nth FROM k),
y AS (SELECT page_id, nth, lower(r[1]) AS tag, regexp_replace(CASE WHEN contains(r[2], chr(4)) THEN regexp_replace(replace(r[2], chr(4), ' '), '  +', ' ', 'g') ELSE r[2] END, '^\\s+|\\s+$', '', 'g') AS content FROM x),
g AS MATERIALIZED (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1)::INT AS ordinal, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' WHEN tag = 'table' THEN 'table' ELSE 'paragraph' END AS region_type,
  CASE WHEN tag LIKE 'h%' THEN tag[2:2]::INT END AS heading_level, content FROM y WHERE content <> '')"""
_REGIONS = REGIONS_SQL
_ABOVE = ", ".join(f"CASE WHEN coalesce(heading_level, 7) > {n} THEN last_value(CASE WHEN heading_level = {n} THEN ordinal END IGNORE NULLS) OVER w END" for n in range(1, 7))
_PARENTS = _REGIONS + f""", p AS MATERIALIZED (SELECT *, greatest({_ABOVE}) AS parent FROM g WINDOW w AS (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_UP = " ".join(f"LEFT JOIN p h{n} ON h{n}.page_id = n.page_id AND h{n}.ordinal = {'n' if n == 1 else f'h{n - 1}'}.parent" for n in range(1, 7))


def _regions(spark, d):
    return L.html_regions(table(spark, d, "pages"))


@query(f"WITH {_REGIONS} SELECT * FROM g")
def html_regions(spark, d):
    return _regions(spark, d)


@query(f"WITH {_PARENTS} SELECT page_id, ordinal, region_type, parent FROM p")
def heading_parent(spark, d):
    return L.parents(_regions(spark, d)).select("page_id", "ordinal", "region_type", "parent")


@query(
    f"""WITH {_PARENTS}, n AS (SELECT page_id, ordinal, parent, concat_ws(chr(10) || chr(10), before, CASE WHEN after IS DISTINCT FROM before THEN after END) AS nearby
FROM (SELECT *, lag(content) OVER w AS before, lead(content) OVER w AS after FROM p WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)))
SELECT n.page_id, n.ordinal, nearby, concat_ws(' > ', h6.content, h5.content, h4.content, h3.content, h2.content, h1.content) AS path FROM n {_UP}"""
)
def region_context(spark, d):
    regions = L.parents(_regions(spark, d))
    paths = L.heading_paths(regions)
    return L.neighbours(regions).join(paths, ["page_id", "ordinal"]).select("page_id", "ordinal", "nearby", F.array_join("path", " > ").alias("path"))


@query(
    f"""WITH {_REGIONS}, s AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN left(content, 30) END AS summary FROM g),
r AS (SELECT page_id, ordinal, 0 AS k, 'text' AS kind, content AS body FROM s WHERE content <> '' UNION ALL SELECT page_id, ordinal, 1, 'caption', summary FROM s WHERE summary IS NOT NULL AND summary <> content
UNION ALL SELECT page_id, ordinal, 2, 'visual', coalesce(summary, content) FROM s WHERE region_type IN ('image', 'chart', 'table'))
SELECT page_id, ordinal, kind, body AS content, (row_number() OVER (PARTITION BY page_id ORDER BY ordinal, k) - 1)::INT AS place FROM r"""
)
def representations(spark, d):
    summary = F.when(F.col("ordinal") % 3 == 0, F.substring("content", 1, 30))
    return L.representations(_regions(spark, d), summary)


@query(
    """WITH s AS (SELECT doc_id AS id, (n_chars % 5000 + 1)::INT AS w, (doc_id * 37 % 3000 + 1)::INT AS h FROM documents),
t AS (SELECT id, w, h, greatest(w, h) <= 2048 AS whole FROM s),
r AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(0, h, 1024) END) AS y0 FROM t), q AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(0, w, 1024) END) AS x0 FROM r)
SELECT id, (CASE WHEN whole THEN 0 ELSE (y0 // 1024) * ceil(w / 1024.0) + x0 // 1024 END)::INT AS tile, x0::INT AS x0, y0::INT AS y0, (CASE WHEN whole THEN w ELSE least(w, x0 + 1024) END)::INT AS x1, (CASE WHEN whole THEN h ELSE least(h, y0 + 1024) END)::INT AS y1 FROM q"""
)
def tile_grid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5000 + 1).cast("int").alias("width"), (F.col("doc_id") * 37 % 3000 + 1).cast("int").alias("height"))
    return L.tiles(docs)


# Ten regions a document, on two surfaces; two charts with captions, one of them under the other surface's chart.
_FIG = """f AS (SELECT doc_id // 10 AS document, doc_id % 10 // 5 AS surface, (doc_id % 10)::INT AS ordinal, CASE doc_id % 10 WHEN 1 THEN 'chart' WHEN 6 THEN 'image' WHEN 2 THEN 'caption' WHEN 7 THEN 'caption' WHEN 5 THEN 'caption' ELSE 'paragraph' END AS region_type,
CASE doc_id % 10 WHEN 2 THEN 'Figure 1: growth' WHEN 7 THEN 'Fig. 2 shares' WHEN 5 THEN 'Figure 3' WHEN 8 THEN 'As figure 1 and Figure 2 show, not figure 3' ELSE text END AS content FROM documents)"""


@query(
    f"""WITH {_FIG}, v AS (SELECT *, last_value(CASE WHEN region_type IN ('chart', 'image', 'table') THEN ordinal END IGNORE NULLS) OVER (PARTITION BY document, surface ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f),
c AS (SELECT document, ordinal AS region, seen AS target, content FROM v WHERE region_type = 'caption' AND seen IS NOT NULL),
n AS (SELECT document, regexp_extract(content, '(?i)\\b(?:figure|fig\\.)\\s*(\\d+)\\b', 1) AS n, target FROM c)
SELECT document, region, target, 'caption_of' AS relation, 0.9::DOUBLE AS confidence FROM c UNION ALL
SELECT DISTINCT f.document, f.ordinal, n.target, 'references', 0.85::DOUBLE FROM f JOIN n ON n.document = f.document AND list_contains(regexp_extract_all(content, '(?i)\\b(?:figure|fig\\.)\\s*(\\d+)\\b', 1), n.n)
WHERE region_type <> 'caption' AND f.ordinal <> n.target"""
)
def figure_relations(spark, d):
    k = F.col("doc_id") % 10
    kind = F.when(k == 1, "chart").when(k == 6, "image").when(k.isin(2, 5, 7), "caption").otherwise("paragraph")
    text = F.when(k == 2, "Figure 1: growth").when(k == 7, "Fig. 2 shares").when(k == 5, "Figure 3").when(k == 8, "As figure 1 and Figure 2 show, not figure 3").otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(F.expr("doc_id div 10").alias("document"), F.expr("doc_id % 10 div 5").alias("surface"), k.cast("int").alias("ordinal"), kind.alias("region_type"), text.alias("content"))
    return L.captions(rows).distinct()


@query(
    """WITH t AS (SELECT page_id // 5 AS document, page_id % 5 AS surface, page_id AS ordinal, (page_id % 7) / 10.0::DOUBLE AS top, 0.6 + (page_id % 5) / 10.0::DOUBLE AS bottom FROM pages)
SELECT x.document, x.ordinal AS region, y.ordinal AS target FROM t x JOIN t y ON x.document = y.document AND x.surface = y.surface + 1 WHERE x.top <= 0.25 AND y.bottom >= 0.75"""
)
def continued_tables(spark, d):
    p = F.col("page_id")
    rows = table(spark, d, "pages").select(F.expr("page_id div 5").alias("document"), (p % 5).alias("surface"), p.alias("ordinal"), F.lit("table").alias("region_type"), ((p % 7) / 10).alias("top"), (0.6 + (p % 5) / 10).alias("bottom"))
    return L.continued_tables(rows, "document", "surface")


@query("SELECT doc_id AS id, round(CASE WHEN doc_id % 6 = 0 THEN 1.0 ELSE least(1.0, (doc_id % 4) / (doc_id % 6)::DOUBLE) END, 6) AS completeness FROM documents")
def layout_completeness(spark, d):
    from tessera.functions.scalars import completeness

    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), F.round(completeness(i % 4, i % 6), 6).alias("completeness"))


@query()  # no SQL: tests/test_layout.py holds it against a brute-force version
def chunk_text(spark, d):
    return L.chunks(Vault(spark, d).searchable(), "id", "text")


@query(f"SELECT id, CASE WHEN size < 1024 THEN size || 'b' ELSE printf('%.1fkb', round(size / 1024.0::DOUBLE, 1)) END AS label FROM {DOCS_SQL}")
def size_labels(spark, d):
    from tessera.functions.scalars import size_label

    return Vault(spark, d).documents().select("id", size_label(F.col("size")).alias("label"))
