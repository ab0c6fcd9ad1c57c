"""The queries of this subpackage and their DuckDB twins, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, exact_dedup, hmm_lm, language_id, line_dedup, media, mixing, near_dedup, packing, prefix_trie, quality, token_counts, url_filter
from tessera.llm._io import stash


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_texts(_documents(spark, sf_dir))
    return media.media_features(stored, ["doc_id", "n_bytes"])


#: Target weights of the mix: the largest source a tenth, the others alike, all unnamed ones like one of them.
MIX = mixing.Settings(weights={"src0": 0.10} | {f"src{i}": 0.045 for i in range(1, 20)}, rest=0.045)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), ["doc_id", "source"], settings=MIX)


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir), settings=near_dedup.Settings(shingle_words=4))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation c with the first crc32(c) % 9 turns of c - c % 5 in place of its own."""
    turns = stash(prefix_trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    c = F.col("conv_id")
    rebuilt = prefix_trie.branched(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    return prefix_trie.trie(rebuilt, turns.select("conv_id").distinct())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_mixing": op2_mixing,
    "op3_hmm_lm": op3_hmm_lm,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT host, path, max({'n': length(h || p), 'rule': h || p, 'v': v}) AS b
    FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, b.rule AS rule, coalesce(b.v, CASE WHEN
    (regexp_matches(url, '(?i)[?&]utm_source=')
     OR regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?blog\..*[^a-z0-9_.%-]page=')
     OR regexp_matches(url, '(?i)[^a-z0-9_.%-]ref=.*[^a-z0-9_.%-]page=')
     OR regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads\.')
     OR regexp_matches(url, '(?i)/track/'))
    AND NOT regexp_matches(url, '(?i)[^a-z0-9_.%-]utm_source=feed[^a-z0-9_.%-].*keep=1$')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path""",
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_prefix_trie": r"""
WITH b AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM b GROUP BY c),
-- crc32 of the decimal digits: a byte, then eight steps of a bit each, marked by -1
crc AS (SELECT c, n, c - c % 5 AS head, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) % 9 AS h FROM n),
s AS (SELECT crc.c, head, h, least(h, coalesce(y.n, 0)) AS kept FROM crc LEFT JOIN n y ON y.c = head),
t AS (SELECT b.c, p - h + kept AS pos, k, bytes FROM b JOIN s USING (c) WHERE p > h UNION ALL SELECT s.c, p, k, bytes FROM s JOIN b ON b.c = head AND p <= h),
paths AS (SELECT c, pos AS depth, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos) AS path, bytes FROM t UNION ALL SELECT c, 0, '', 0 FROM n),
last AS (SELECT c, max(depth) AS n_turns FROM paths GROUP BY c),
nodes AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n_turns) AS ends FROM paths JOIN last USING (c) GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, len(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
x AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
above AS (SELECT x.*, unnest(range(0, depth + 1)) AS up FROM x),
sums AS (SELECT up AS depth, left(path, 32 * up) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT x.conv_id, x.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN sums USING (depth, path) LEFT JOIN nodes parent ON x.depth > 0 AND parent.depth = x.depth - 1 AND parent.path = left(x.path, len(x.path) - 32)""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, w AS words, phrase, count(*) AS f FROM (SELECT lang, w, unnest([array_to_string(ws[i:i + w - 1], ' ') FOR i IN range(1, len(ws) - w + 2)]) AS phrase FROM p, (VALUES (1), (2), (3), (4)) v(w)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k FROM g WHERE words > 1),
s AS (SELECT c.lang, c.phrase, c.words, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest(list_distinct(flatten([[array_to_string(ws[i:i + w - 1], ' ') FOR i IN range(1, words - w + 2)] FOR w IN range(2, words)]))) AS phrase, f FROM (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE words > 2)),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN tot USING (lang) LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * a QUALIFY rank <= 2000""",
    "op13_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, top IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
