"""Graph queries: centroids, neighbours, clusters, co-retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.plans.registry import query
from tessera.sources.vault import DOCS_SQL, VECTORS_SQL, Vault, table
from tessera.streaming import limits

NOW = "2001-08-02 00:00:00"
HALF_LIFE = 24.0 * 365  # the tables span years


def _l2(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM {VECTORS_SQL}) GROUP BY label, pos")
def doc_centroid(spark, d):
    found = G.centroids(Vault(spark, d).vectors(), "label")
    return found.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("value"))


@query(
    f"""SELECT qid, id, rank, round(distance, 5) AS distance FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_l2("e.embedding", "q.embedding")} AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_l2("e.embedding", "q.embedding")}, 9), e.vec_id) AS rank FROM {VECTORS_SQL} e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 3""",
    rank="rank",
)
def knn_edges(spark, d):
    v = Vault(spark, d).vectors()
    near = R.nearest(v, table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 3, "l2", skip_self=True)
    return near.select("qid", "id", "rank", F.round("distance", 5).alias("distance"))


_VECTORS = f"v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM {VECTORS_SQL})"


def seeds_sql(k: int) -> str:
    """c0 (c, m): k centres of v (id, x), each drawn by its squared distance to those before it."""
    u = lambda i: f"((('0x' || substr(md5('0:{i}:' || v.id), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE)"
    out = [f"p0 AS MATERIALIZED (SELECT id, x, 0 AS c FROM v ORDER BY -ln({u(0)}), id LIMIT 1)"]
    for i in range(1, k):
        far = "min(list_distance(v.x, p.x))"
        out.append(f"p{i} AS MATERIALIZED (FROM p{i - 1} UNION ALL SELECT * FROM (SELECT v.id, v.x, {i} FROM v, p{i - 1} p GROUP BY v.id, v.x HAVING {far} > 0 ORDER BY -ln({u(i)}) / pow({far}, 2), v.id LIMIT 1))")
    return ", ".join([*out, f"c0 AS MATERIALIZED (SELECT c, x AS m FROM p{k - 1})"])


def kmeans_sql(k: int, steps: int, source: str = _VECTORS, start: str | None = None) -> str:
    """Lloyd's steps unrolled, from the k least ids unless start says c0."""
    out = [f"WITH {source}", start or f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x AS m FROM v ORDER BY id LIMIT {k})"]
    near = lambda i: f"SELECT id, x, arg_min(c, (round(list_distance(x, m), 9), c)) AS c, min(round(list_distance(x, m), 9)) AS d FROM v, c{i} GROUP BY id, x"
    for i in range(steps):
        out.append(f"a{i} AS ({near(i)})")
        out.append(f"s{i} AS (SELECT c, p, avg(x[p]) AS y FROM a{i}, range(1, 65) t(p) GROUP BY c, p)")
        out.append(f"c{i + 1} AS (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(y ORDER BY p) AS m FROM s{i} GROUP BY c) n ON n.c = o.c)")
    return ", ".join(out) + f" SELECT id, c::INT AS cluster, round(d, 5) AS distance FROM ({near(steps)})"


@query(kmeans_sql(8, 3))
def kmeans_fixed_init(spark, d):
    found = G.kmeans(Vault(spark, d).vectors(), 8, iterations=3)
    return found.select("id", "cluster", F.round("distance", 5).alias("distance"))


@query(kmeans_sql(8, 3, start=seeds_sql(8)))
def kmeans_plus_plus(spark, d):
    """Three steps from centres that were drawn by squared distance."""
    v = Vault(spark, d).vectors()
    found = G.kmeans(v, 8, iterations=3, start=G.seeds(v, 8))
    return found.select("id", "cluster", F.round("distance", 5).alias("distance"))


# Each document's parent is the one before it, in chains of fifty; every seventh chain is a ring.
_CHAINS = "n AS (SELECT doc_id AS node, CASE WHEN doc_id % 50 > 0 THEN doc_id - 1 WHEN doc_id // 50 % 7 = 6 AND doc_id + 49 IN (SELECT doc_id FROM documents) THEN doc_id + 49 END AS parent FROM documents)"


@query(
    f"""WITH RECURSIVE {_CHAINS}, u AS (SELECT node, node AS top, parent, [node] AS seen, false AS looped FROM n
UNION ALL SELECT u.node, CASE WHEN list_contains(seen, n.node) THEN top ELSE n.node END, CASE WHEN list_contains(seen, n.node) THEN NULL ELSE n.parent END, CASE WHEN list_contains(seen, n.node) THEN seen ELSE list_append(seen, n.node) END, list_contains(seen, n.node) FROM u JOIN n ON u.parent = n.node)
SELECT node, len(seen) - 1 AS depth, array_to_string(list_reverse(seen[2:]), ' > ') AS path, looped FROM u QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(seen) DESC, looped DESC) = 1""".replace("len(seen) - 1 AS depth", "(len(seen) - 1)::INT AS depth")
)
def ancestor_paths(spark, d):
    """All ancestors of all nodes of chains and rings, whatever their depth."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    ends = docs.select((i - 49).alias("doc_id"), F.lit(True).alias("closed"))
    ring = F.col("closed") & (F.expr("doc_id div 50") % 7 == 6)
    nodes = docs.join(ends, "doc_id", "left").select(i.alias("node"), F.when(i % 50 > 0, i - 1).when(ring, i + 49).alias("parent"))
    found = G.ancestors(nodes)
    return found.select("node", F.size("path").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), " > ").alias("path"), "looped")


@query()
def pca_3d(spark, d):
    return G.project_3d(Vault(spark, d).vectors())


@query(
    f"""WITH m AS (SELECT label, list(y ORDER BY p) AS m FROM (SELECT label, p, avg((embedding::DOUBLE[])[p]) AS y FROM {VECTORS_SQL}, range(1, 65) t(p) GROUP BY label, p) GROUP BY label)
SELECT vec_id AS id, arg_min(m.label, (round({_l2("embedding", "m")}, 9), m.label))::INT AS cluster, round(min({_l2("embedding", "m")}), 5) AS distance FROM {VECTORS_SQL}, m GROUP BY vec_id"""
)
def nearest_centroid(spark, d):
    v = Vault(spark, d).vectors()
    centres = G.centroids(v, "label").withColumnRenamed("label", "cluster")
    return G.place(v, centres).select("id", "cluster", F.round("distance", 5).alias("distance"))


@query(
    f"""WITH m AS (SELECT label, list(y ORDER BY p) AS m FROM (SELECT label, p, avg((embedding::DOUBLE[])[p]) AS y FROM {VECTORS_SQL}, range(1, 65) t(p) GROUP BY label, p) GROUP BY label)
SELECT vec_id AS id, arg_min(m.label, (round({_l2("embedding", "m")}, 9), m.label))::INT AS cluster FROM embeddings, m GROUP BY vec_id"""
)
def stream_placement(spark, d):
    """nearest_centroid for vectors that arrive as a stream."""
    centres = G.centroids(Vault(spark, d).vectors(), "label").withColumnRenamed("label", "cluster")
    stream = spark.readStream.schema(table(spark, d, "embeddings").schema).parquet(f"{d}/embeddings*.parquet")
    placed = limits.place_stream(stream.select(F.col("vec_id").alias("id"), "embedding"), centres)
    return limits.drain(placed).select("id", "cluster")


_TURNS = "t AS (SELECT l_orderkey AS turn, l_partkey AS chunk, max(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_EDGES = f"WITH {_TURNS}, e AS (SELECT x.chunk AS a, y.chunk AS b, count(*)::DOUBLE AS weight, count(*) AS turns, max(x.ts) AS last FROM t x JOIN t y ON x.turn = y.turn AND x.chunk < y.chunk GROUP BY ALL)"
_LINKED = _EDGES + f""", l AS (SELECT DISTINCT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_partkey % 50 = 0),
w AS (SELECT e.a, e.b, e.weight, e.turns, e.last, false AS explicit FROM e ANTI JOIN l USING (a, b) UNION ALL SELECT l.a, l.b, 5.0, 0, e.last, true FROM l LEFT JOIN e USING (a, b)),
f AS (SELECT *, CASE WHEN explicit THEN weight ELSE weight * pow(0.5, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last)) / 3.6e9 / {HALF_LIFE}) END AS effective FROM w)"""


def _edges(spark, d):
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    n = G.tasks_for(lines, lines.count())
    turns = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return G.co_retrieval(turns.select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("chunk"), F.col("o_orderdate").alias("ts")))


def _linked(spark, d):
    links = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b"))
    return G.effective(G.link_explicitly(_edges(spark, d), links), F.lit(NOW).cast("timestamp"), HALF_LIFE)


@query(_EDGES + " SELECT a, b, weight, turns, epoch_us(last) AS last FROM e")
def co_retrieval_edges(spark, d):
    return _edges(spark, d).select("a", "b", "weight", "turns", F.unix_micros(F.col("last").cast("timestamp")).alias("last"))


@query(_LINKED + " SELECT a, b, turns, explicit, round(effective, 6) AS effective FROM f")
def decayed_edges(spark, d):
    return _linked(spark, d).select("a", "b", "turns", "explicit", F.round("effective", 6).alias("effective"))


@query(
    _LINKED
    + """ SELECT least(x.p_brand, y.p_brand) AS document_a, greatest(x.p_brand, y.p_brand) AS document_b, round(sum(effective), 4) AS weight, bool_or(explicit) AS explicit
FROM f JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_brand <> y.p_brand GROUP BY 1, 2 HAVING sum(effective) >= 1.5"""
)
def associative_doc_edges(spark, d):
    owner = table(spark, d, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_brand").alias("document"))
    return G.document_links(_linked(spark, d), owner).select("document_a", "document_b", F.round("weight", 4).alias("weight"), "explicit")


@query(_EDGES + " SELECT a, b, turns FROM e WHERE a IN (SELECT p_partkey FROM part WHERE p_size = 7) OR b IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def edges_touching(spark, d):
    return G.touching(_edges(spark, d).select("a", "b", "turns"), table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("chunk")))


@query(_LINKED + " SELECT a, b, round(CASE WHEN explicit THEN 1.0 ELSE least(1.0, effective / (SELECT greatest(1.0, max(effective)) FROM f)) END, 6) AS brightness FROM f")
def edge_brightness(spark, d):
    return G.brightness(_linked(spark, d)).select("a", "b", F.round("brightness", 6).alias("brightness"))


@query(f"SELECT d.id, d.status, e.label FROM {DOCS_SQL} d LEFT JOIN embeddings e ON e.vec_id = d.id WHERE d.status IN ('ready', 'sealed')")
def graph_nodes(spark, d):
    vault = Vault(spark, d)
    docs = vault.documents().where(F.col("status").isin("ready", "sealed"))
    return docs.join(vault.all_vectors().select("id", "label"), "id", "left").select("id", "status", "label")


@query("SELECT l_orderkey AS turn, l_partkey AS chunk, l_shipdate::VARCHAR AS at FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1".replace("AS at", "AS shipped"))
def upsert_latest(spark, d):
    rows = G.last_of(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], [F.col("l_shipdate"), F.col("l_linenumber")])
    return rows.select(F.col("l_orderkey").alias("turn"), F.col("l_partkey").alias("chunk"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@query("SELECT greatest(1, round_even(sqrt(n / 2.0), 0))::INT AS k, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def choose_k(spark, d):
    from tessera.functions.scalars import choose_k as k

    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select(k(F.col("n")).alias("k"), "n")
