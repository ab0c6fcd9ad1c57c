from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.operators import structure as S


def test_short_blank_and_repeated_words():
    assert L.cut_text("short") == [(0, "short")] and L.cut_text("  \n ") == [] and L.cut_text(None) == []
    assert len(L.cut_text("word " * 500)) == 3


def test_boundaries():
    cut = lambda text: L.cut_text(text, 100, 10)[0][1]
    assert cut("a" * 84 + "\n\n" + "b c d e f g h i j k l") == "a" * 84
    assert cut("a" * 84 + ". bbb ccc ddd eee fff") == "a" * 84 + "."
    assert cut("a" * 82 + ". b! c d e f g h i j k l m n").endswith("b!")
    assert cut("a" * 82 + "\nb c d e f g h i j k l m n") == "a" * 82
    assert cut("a" * 82 + " b c d e f ggggggggggggggggggg") == "a" * 82 + " b c d e f"
    assert all(len(p) <= 1000 for _, p in L.cut_text("z" * 3000)) and "".join(p for _, p in L.cut_text("z" * 3000, 1000, 0)) == "z" * 3000


def test_a_piece_begins_at_a_word():
    text = " ".join(f"word{i}" for i in range(600))
    for at, piece in L.cut_text("  " + text):
        assert ("  " + text)[at:].startswith(piece) and piece.startswith("word") and len(piece) <= 1000


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 80))
def test_no_gap_and_an_end(text, size, overlap):
    pieces = L.cut_text(text, size, overlap)
    covered = set()
    for at, piece in pieces:
        assert len(piece) <= size
        start = text.index(piece, at)
        covered |= set(range(start, start + len(piece)))
    assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_markdown(spark):
    df = spark.createDataFrame([(1, "# Project\n\nIntro paragraph.\n\n## Details\n\n- first\n- second\n"), (2, "\n  Alpha. \n \n\nBeta.\n\n```\nx\n```\n\n"), (3, ""), (4, None)], "id long, text string")
    rows = L.parents(S.markdown_regions(df), "id").orderBy("id", "ordinal").collect()
    assert [(r["id"], r["region_type"], r["heading_level"], r["content"], r["parent"]) for r in rows] == [
        (1, "heading", 1, "Project", None),
        (1, "paragraph", None, "Intro paragraph.", 0),
        (1, "heading", 2, "Details", 0),
        (1, "list", None, "- first\n- second", 2),
        (2, "paragraph", None, "Alpha.", None),
        (2, "paragraph", None, "Beta.", None),
        (2, "code", None, "```\nx\n```", None),
    ]
    for r in S.text_blocks(df).join(df, "id").collect():
        assert r["text"][r["text_start"] : r["text_end"]] == r["content"]


def test_tiles(spark):
    df = spark.createDataFrame([(1, 800, 600), (2, 2500, 1200)], "id long, width int, height int")
    rows = L.tiles(df).orderBy("id", "tile").collect()
    assert [r[1:] for r in rows if r["id"] == 1] == [(0, 0, 0, 800, 600)]
    assert len(rows) == 7 and rows[-1][1:] == (5, 2048, 1024, 2500, 1200)


def test_captions_and_tables(spark):
    schema = "document int, surface int, ordinal int, region_type string, content string"
    df = spark.createDataFrame([(1, 0, 0, "chart", ""), (1, 0, 1, "caption", "Figure 3: Growth"), (1, 0, 2, "paragraph", "Figure 3 shows growth."), (1, 1, 3, "caption", "Figure 4"), (1, 1, 4, "paragraph", "fig. 3")], schema)
    assert {(r["region"], r["target"], r["relation"]) for r in L.captions(df).collect()} == {(1, 0, "caption_of"), (2, 0, "references"), (4, 0, "references")}
    tables = spark.createDataFrame([("d", 0, 0, "table", 0.5, 0.98), ("d", 1, 1, "table", 0.02, 0.9), ("d", 1, 2, "table", 0.91, 0.6), ("d", 2, 3, "table", 0.02, 0.4)], "doc string, surface int, ordinal int, region_type string, top double, bottom double")
    assert [tuple(r) for r in L.continued_tables(tables, "doc", "surface").collect()] == [("d", 1, 0)]


def test_words_in_lines_and_blocks(spark):
    words = [("p", "Title", 50, 20, 100, 40, 20.0), ("p", "b", 110, 102, 150, 112, 10.0), ("p", "a", 50, 100, 100, 110, 10.0), ("p", "next", 52, 115, 90, 125, 10.0), ("p", "Figure", 50, 300, 90, 310, 10.0), ("p", "2", 95, 300, 99, 310, 10.0), ("p", "note", 50, 900, 90, 906, 6.0)]
    df = spark.createDataFrame([(*w, 600.0, 1000.0) for w in [(p, t, *map(float, x)) for p, t, *x in words]], "page string, text string, x0 double, top double, x1 double, bottom double, size double, width double, height double")
    lines = S.page_lines(df)
    assert [(r["content"], r["region_type"]) for r in lines.orderBy("line").collect()] == [("Title", "heading"), ("a b", "paragraph"), ("next", "paragraph"), ("Figure 2", "caption"), ("note", "footnote")]
    assert [r["content"] for r in S.page_blocks(lines).orderBy("block").collect()] == ["Title", "a b next", "Figure 2", "note"]


def test_two_columns(spark):
    boxes = [(0.05, 0.95, 0.5), (0.55, 0.9, 0.1), (0.1, 0.45, 0.2), (0.1, 0.45, 0.1)]
    df = spark.createDataFrame([("p", i, x0, top, x1) for i, (x0, x1, top) in enumerate(boxes)], "page string, block int, x0 double, top double, x1 double")
    assert [r["block"] for r in S.reading_order(df).orderBy("reading_order").collect()] == [0, 3, 2, 1]
    assert [r["block"] for r in S.reading_order(df.where("block IN (0, 2)")).orderBy("reading_order").collect()] == [2, 0]


def test_blocks_with_inner_tags():
    one = lambda html: L.regions_of(html)
    assert one('<ul><li><a href="/x">first</a></li><li>second</li></ul>') == [("li", "first"), ("li", "second")]
    assert one("<p><b>bold</b>er <i>x</i> y<p>next<br>line</p>") == [("p", "bolder x y"), ("p", "next line")]
    assert one("<table><tr><td>a</td><td><p>b</p></td></tr><tr><th>c</th></tr></table> out") == [("table", "a b c")]
    assert one("<table><tr><td>a<tr><td>b</table><p>after</p>") == [("table", "a b"), ("p", "after")]
    assert one("<h3>Three</h3><H6 class=x>Six</H6>") == [("h3", "Three"), ("h6", "Six")]
    assert one("<li>a<ul><li>b</li></ul>tail</li>") == [("li", "a tail"), ("li", "b")]
    assert one("<article><p>open</article><footer>&copy; no region</footer>") == [("p", "open")]
    assert one("<p>x<!-- <p>no --> y<script>var t='<p>no</p>'</script> 1 < 2 &amp; z</p><p> <b> </b></p>") == [("p", "x y 1 < 2 &amp; z")]
    assert one("<p>cut <b>off</b") == [("p", "cut off")] and one(None) == [] and one("") == []


def test_every_block_of_the_pages_is_a_region(spark, sf):
    """Against html.parser, which knows nothing of regions_of(): all words of list items, paragraphs and headings, page by page."""
    from collections import Counter
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.block, self.found = None, []

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "li", "h1"):
                self.block = [tag, ""]
                self.found.append(self.block)
            elif tag == "br" and self.block:
                self.block[1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "li", "h1", "article", "ul", "body", "html"):
                self.block = None

        def handle_data(self, data):
            if self.block:
                self.block[1] += data

        def handle_entityref(self, name):
            if self.block:
                self.block[1] += f"&{name};"

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = Counter()
    for r in pages.collect():
        p = Words()
        p.feed(r["html"] or "")
        p.close()
        want.update((r["page_id"], {"p": "paragraph", "li": "list", "h1": "heading"}[tag], " ".join(text.split())) for tag, text in p.found if text.strip())
    got = Counter((r["page_id"], r["region_type"], " ".join(r["content"].split())) for r in L.html_regions(pages).collect())
    assert got == want and sum(n for (_, kind, _), n in got.items() if kind == "list") > 100


def test_lines_of_many_pages_are_those_of_a_plain_version_and_words_are_shuffled_once(spark):
    import random
    import re
    from statistics import median

    rng = random.Random(5)
    words = []
    for page in [*"abcdefgh", None]:
        for _ in range(rng.choice([1, 30, 400])):
            top = rng.choice([rng.randrange(0, 900), rng.randrange(0, 60), 2.0 + 4 * rng.randrange(0, 200)])
            x0 = rng.choice([None, *range(0, 600, 40)])
            words.append((page, rng.choice(["a", "b", "Figure", "7", " ", "", None, "né"]), x0, float(top), None if x0 is None else x0 + 30.0, top + 10.0, rng.choice([None, 0.0, 6.0, 10.0, 20.0]), 600.0, 1000.0))
    words = [(p, t, None if x is None else float(x), *more) for p, t, x, *more in words]
    want = []
    for page in {w[0] for w in words}:
        low = lambda v: (v is not None, v)
        own = sorted((w for w in words if w[0] == page), key=lambda w: (round(w[3] / 4), low(w[2]), w[3]))
        lines = []
        for w in own:
            if not lines or abs(w[3] - lines[-1][0][3]) > 4:
                lines.append([])
            lines[-1].append(w)
        sizes = [w[6] for w in own if w[6]]
        typical = median(sizes) if sizes and page else 0
        for n, line in enumerate(lines):
            content = " ".join(w[1] for w in sorted(line, key=lambda w: (low(w[2]), w[3], low(w[1]))) if w[1] is not None).strip(" ")
            most = lambda i, f: f([w[i] for w in line if w[i] is not None], default=None)  # noqa: B023, E731
            size, top = most(6, max) or 0, most(3, min)
            kind = "caption" if re.match(r"Figure\s+7", content) else "footnote" if top > 860 and 0 < size < typical * 0.9 else "heading" if typical and size >= typical * 1.25 else "paragraph"
            if content:
                share = lambda v, whole: min(1.0, max(0.0, v / whole)) if v is not None else 0.0
                want.append((page, n, content, share(most(2, min), 600), top / 1000, 1.0 if most(4, max) is None else share(most(4, max), 600), kind))
    schema = "page string, text string, x0 double, top double, x1 double, bottom double, size double, width double, height double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        lines = S.page_lines(spark.createDataFrame(words, schema))
        got = [(r["page"], r["line"], r["content"], r["x0"], r["top"], r["x1"], r["region_type"]) for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (r[0] or "", r[1])
    bad = [(g, w) for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True) if (g[:3], g[4], g[6]) != (w[:3], w[4], w[6])]
    assert len({w[6] for w in want}) >= 3 and not bad, bad[:3]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
