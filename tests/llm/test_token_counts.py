import numpy as np

from tessera.llm import _tokens
from tessera.llm import token_counts as C
from tessera.llm.queries import op4_token_counts


def _lengths(df):
    return np.array([len(_tokens.ids(_tokens.default_path(), r["text"])) for r in df.collect()])


def test_query_against_brute_force(spark, sf):
    n = _lengths(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = op4_token_counts(spark, sf).collect()
    assert sorted(r["length"] for r in rows) == sorted(set(n.tolist()))
    for r in rows:
        x = r["length"]
        assert (r["n_docs"], r["docs_at_most"], r["docs_longer"], r["total_tokens"], r["tokens_in_longer"], r["truncated_tokens"]) == ((n == x).sum(), (n <= x).sum(), (n > x).sum(), n.sum(), n[n > x].sum(), np.minimum(n, x).sum())
        assert abs(r["fraction_at_most"] - (n <= x).mean()) < 1e-12


def test_limits_and_quantiles(spark, sf, awkward):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        n, held = _lengths(df), C.length_histogram(df)
        for r in C.totals_at(held, [1, 64, 2048, 10**6]).collect():
            x = r["context_limit"]
            assert (r["docs_whole"], r["docs_cut"], r["kept_tokens"], r["cut_tokens"], r["chunks"]) == ((n <= x).sum(), (n > x).sum(), np.minimum(n, x).sum(), np.maximum(n - x, 0).sum(), np.maximum(1, -(-n // x)).sum())
        for r in C.quantiles(held, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
            assert r["length"] == min(x for x in n if (n <= x).mean() >= r["fraction"] - 1e-12)


def test_awkward_rows(awkward, empty):
    rows = {r["length"]: r["n_docs"] for r in C.length_histogram(awkward).collect()}
    assert rows[0] == 2 and sum(rows.values()) == awkward.count()
    assert C.token_counts(empty).count() == 0
