"""URL filters: rules indexed by their rarest literal token.

A URL's tokens are its maximal runs of letters and digits, lower-cased. Each rule has literal tokens that stand whole in every
URL it can match; it is filed under the one that the fewest URLs of the table have (a rule without any, under the empty token,
which every URL has). A URL's tokens fetch candidate rules, and only those run their regular expression. DataFrame functions
only. The rules are a configuration: up to INLINE_RULES of them go along as a map by token, and every row is judged where it is
read, so only the tokens' counts are shuffled. More rules are joined to the distinct URLs' tokens, by a broadcast up to
BROADCAST_RULES. Both ways give the same rows.

Two kinds of rules:

* site rules (host, path): fit the host and its subdomains where the URL's path starts with theirs; the longest wins;
* patterns, with `*` for anything, `^` for one separator (anything but letters, digits and `_-.%`) or the end, `||` for a
  host's beginning and `|` for either end of the URL; they decide where no site rule fits: blocked if one blocks and none allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import fresh

INLINE_RULES, BROADCAST_RULES = 256, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return r"^(?:[^/]*\.)?" + _quoted(self.text)

    @property
    def tokens(self) -> list[str]:
        """The host's labels, and the path's runs that something literal ends."""
        return sorted({*_runs(self.host), *(m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", self.path))})


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str

    @property
    def regex(self) -> str:
        body, head, tail = self.text, "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        return "(?i)" + head + "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or _quoted(c) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Runs that something literal, a separator or an anchor bounds on either side."""
        body = self.text.removeprefix("||").removeprefix("|").removesuffix("|")
        front, back = self.text.startswith("|"), self.text.endswith("|")
        found = set()
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = body[m.start() - 1] != "*" if m.start() else front
            right = body[m.end()] != "*" if m.end() < len(body) else back
            if left and right:
                found.add(m[0].lower())
        return sorted(found)


def _runs(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_:,=&%;@ -])", r"\\\1", text)


#: What the contract of the URL query names.
SITE_RULES = [
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
]
#: Trackers' and listings' addresses; they decide where no site rule fits.
PATTERNS = [
    Pattern("?utm_source=", "block"),
    Pattern("&utm_source=", "block"),
    Pattern("||blog.*^page=", "block"),
    Pattern("^ref=*^page=", "block"),
    Pattern("||ads.", "block"),
    Pattern("/track/", "block"),
    Pattern("^utm_source=feed^*keep=1|", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path as it stands; both empty for null and where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    """Its distinct tokens; the empty one always among them."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+")))


def rule_index(urls: DataFrame, url_col: str, rules: list[SiteRule | Pattern]) -> DataFrame:
    """(token, kind, rule, regex, verdict): each rule under that of its tokens which the fewest rows of urls have."""
    spark = urls.sparkSession
    kinds = "kind string, rule string, regex string, verdict string, tokens array<string>"
    table = spark.createDataFrame([(type(r).__name__, r.text, r.regex, r.verdict, r.tokens or [""]) for r in rules], kinds)
    pairs = table.select("*", F.explode("tokens").alias("token")).drop("tokens")
    wanted = pairs.select("token").where("token <> ''").distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    seen = urls.where(F.col(url_col).isNotNull()).select(F.explode(_tokens(F.col(url_col))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = pairs.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("kind", "rule", "regex", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def _verdict(best: Column, blocks: Column, allows: Column) -> Column:
    return F.coalesce(best["verdict"], F.when((blocks > 0) & (allows == 0), "block").otherwise("allow"))


def _inline(url: Column, index: DataFrame) -> tuple[Column, Column, Column]:
    """Of a url: the best site rule (n, rule, verdict), the blocking and the allowing patterns that match. index: the rules by token, at most INLINE_RULES rows."""
    by_token: dict[str, list] = {}
    for r in index.select("token", "kind", "rule", "regex", "verdict").collect():
        by_token.setdefault(r["token"], []).append(r)
    struct = lambda r: F.struct(F.lit(r["kind"] == "SiteRule").alias("site"), F.lit(r["rule"]).alias("rule"), F.lit(r["regex"]).alias("regex"), F.lit(r["verdict"]).alias("verdict"))
    table = F.create_map(*[x for t, rules in by_token.items() for x in (F.lit(t), F.array(*map(struct, rules)))])
    known = F.array(*[F.lit(t) for t in by_token])
    host, path = host_and_path(url)
    candidates = F.flatten(F.transform(F.array_intersect(_tokens(url), known), lambda t: F.element_at(table, t)))
    hits = F.filter(candidates, lambda r: F.rlike(F.when(r["site"], F.concat(host, path)).otherwise(url), r["regex"]))
    best = F.array_max(F.transform(F.filter(hits, lambda r: r["site"]), lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    count = lambda verdict: F.size(F.filter(hits, lambda r: ~r["site"] & (r["verdict"] == verdict))).cast("long")
    return best, count("block"), count("allow")


def _judged(df: DataFrame, url_col: str, rules: list[SiteRule | Pattern]) -> DataFrame:
    """df with a struct `_judged` of host, path, rule, verdict, block_patterns and allow_patterns, each row in place. df has no column of that name."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    if rules:
        best, blocks, allows = _inline(url, rule_index(df, url_col, rules))
    else:
        best, blocks, allows = F.lit(None).cast("struct<n: int, rule: string, verdict: string>"), F.lit(0).cast("long"), F.lit(0).cast("long")
    held, none = fresh(df, "held"), F.coalesce(blocks, F.lit(0).cast("long"))
    rows = df.withColumn(held, F.struct(host.alias("host"), path.alias("path"), best.alias("best"), none.alias("blocks"), F.coalesce(allows, F.lit(0).cast("long")).alias("allows")))
    h = F.col(held)
    verdict = _verdict(h["best"], h["blocks"], h["allows"])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(h["host"].alias("host"), h["path"].alias("path"), h["best"]["rule"].alias("rule"), verdict.alias("verdict"), h["blocks"].alias("block_patterns"), h["allows"].alias("allow_patterns")).alias("_judged"))


def judge_urls(df: DataFrame, url_col: str = "url", site_rules: list[SiteRule] = SITE_RULES, patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """One row per distinct url: url, host, path, rule, verdict, block_patterns, allow_patterns.

    A null url has an empty host and path, no rule, and the verdict allow. Repeated urls give one row (join it to the table);
    an empty table gives an empty one. Without any rule everything is allowed.
    """
    rules = [*site_rules, *patterns]
    urls = df.groupBy(F.col(url_col).alias("url")).agg(F.lit(1).alias("one")).select("url")
    if len(rules) <= INLINE_RULES:
        judged = _judged(urls, "url", rules)
        return judged.select("url", "_judged.*")
    host, path = host_and_path(F.col("url"))
    index = rule_index(df, url_col, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    found = urls.where(F.col("url").isNotNull()).select("url", F.explode(_tokens(F.col("url"))).alias("token")).join(index, "token")
    found = found.where(F.rlike(F.when(F.col("kind") == "SiteRule", F.concat(host, path)).otherwise(F.col("url")), F.col("regex")))
    site = F.col("kind") == "SiteRule"
    best = F.max(F.when(site, F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    hits = found.groupBy("url").agg(best.alias("best"), F.count_if(~site & (F.col("verdict") == "block")).alias("blocks"), F.count_if(~site & (F.col("verdict") == "allow")).alias("allows"))
    blocks, allows = F.coalesce("blocks", F.lit(0)), F.coalesce("allows", F.lit(0))
    return urls.join(hits, "url", "left").select("url", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), _verdict(F.col("best"), blocks, allows).alias("verdict"), blocks.alias("block_patterns"), allows.alias("allow_patterns"))


def filter_pages(df: DataFrame, keep: list[str | Column], url_col: str = "url", site_rules: list[SiteRule] = SITE_RULES, patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """The columns `keep` of every row of df, repeated rows too, with host, path, rule and verdict. Where `keep` has one of these names, the operator's column begins with an underscore."""
    kept = df.select(*keep)
    taken, names = {c.lower() for c in kept.columns}, ["host", "path", "rule", "verdict"]
    named = [fresh(kept, n) if n in taken else n for n in names]
    rows = df.select(F.struct(*keep).alias("kept"), F.col(url_col).alias("url"))
    if len(site_rules) + len(patterns) <= INLINE_RULES:
        judged = _judged(rows, "url", [*site_rules, *patterns]).select("kept", F.col("_judged").alias("of"))
    else:
        of = judge_urls(df, url_col, site_rules, patterns)
        of = of.select(F.coalesce("url", F.lit("")).alias("key"), F.col("url").isNull().alias("none"), F.struct(*names).alias("of"))
        judged = rows.withColumns({"key": F.coalesce("url", F.lit("")), "none": F.col("url").isNull()}).join(of, ["key", "none"]).select("kept", "of")
    return judged.select("kept.*", *[F.col(f"of.{n}").alias(a) for n, a in zip(names, named, strict=True)])
