import random
import re

from tessera.llm import url_filter as U
from tessera.llm.queries import op6_url_filter


def _brute(url, sites, patterns):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in sites if url is not None and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.text), r.text))
        return host, path, best.text, best.verdict
    hits = {p.verdict for p in patterns if url is not None and re.search(p.regex, url)}
    return host, path, None, "block" if hits == {"block"} else "allow"


def _rows(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert _rows(op6_url_filter(spark, sf)) == sorted(((p["page_id"], *_brute(p["url"], U.SITE_RULES, U.PATTERNS)) for p in pages), key=str)


def test_random_urls(spark, monkeypatch):
    rng = random.Random(5)
    hosts = ["org", "a.org", "xorg", "EXAMPLE.org", "www.example.org", "notexample.org", "com", "b.com", "ads.x.net", "blog.x.net", "example.org.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/x", "/de/", "/DE/", "/track/", "/a/track/b"]
    tails = ["", "?utm_source=x", "?a=1&utm_source=feed&keep=1", "?ref=x&page=2", "#page=1", "?page=3", "?ref=1#://x/es/"]
    urls = [f"{rng.choice(['http://', 'https://', '', 'x:/', '://'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(1500)] + ["", None, None, "http://", "a\nb://C.org/\n?x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(((i, *_brute(u, U.SITE_RULES, U.PATTERNS)) for i, u in enumerate(urls)), key=str)
    assert _rows(U.filter_pages(df, ["page_id"])) == want
    judged = U.judge_urls(df).collect()
    monkeypatch.setattr(U, "INLINE_RULES", 0)  # the way of many rules
    assert _rows(U.filter_pages(df, ["page_id"])) == want and sorted(map(str, U.judge_urls(df).collect())) == sorted(map(str, judged))
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert _rows(U.filter_pages(df, ["page_id"])) == want


def test_a_rule_is_filed_under_its_rarest_token(spark):
    df = spark.createDataFrame([("http://www.common.net/path",)] * 3 + [("http://rare.common.net/",)], "url string")
    rules = [U.SiteRule("rare.common.net", "/", "block"), U.SiteRule("never.common.net", "/", "block"), U.Pattern("*", "allow")]
    assert {r["rule"]: r["token"] for r in U.rule_index(df, "url", rules).collect()} == {"rare.common.net/": "rare", "never.common.net/": "never", "*": ""}


def test_only_candidates_run_and_no_python(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    plan = U.filter_pages(df, ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0, plan  # rows are judged where they are read; only the tokens' counts were shuffled
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_awkward_rows(spark):
    rows = [(1, None, "h", "r"), (1, None, "h", "r"), (2, "", None, None), (3, "https://Example.ORG/es/" + "x" * 100_000, "h", "r"), (4, "no scheme", "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = _rows(U.filter_pages(df, ["page_id"]))
    assert [(r[0], r[1], r[3], r[4]) for r in found] == [(1, "", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "example.org", "example.org/es/", "block"), (4, "", None, "allow")]
    assert U.filter_pages(df.where("false"), ["page_id"]).count() == 0
    assert {r["verdict"] for r in U.filter_pages(df, ["page_id"], site_rules=[], patterns=[]).collect()} == {"allow"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("http://a.org/", "h", "u", "j", "k")], "url string, host string, _url string, _judged string, kept string")
    out = U.filter_pages(df, ["host", "_url", "_judged", "kept", "url"])
    assert out.columns == ["host", "_url", "_judged", "kept", "url", "_host", "path", "rule", "verdict"]
    assert out.first()[:] == ("h", "u", "j", "k", "http://a.org/", "a.org", "/", "org/", "allow")
