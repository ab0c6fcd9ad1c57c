"""Regions of pages, their headings, relations, representations and context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9:-]*)[^>]*(?:>|$)|<[/!?][^>]*(?:>|$)", re.IGNORECASE | re.DOTALL)
REGION_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table"}
CELLS = {"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
CONTAINERS = CELLS | set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html main menu nav ol pre section summary ul".split())
CHUNK, OVERLAP, LOOK_BACK = 1000, 100, 0.2
TILE, WHOLE, MOST_DRAWINGS = 1024, 2048, 20


def regions_of(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of a page's blocks with text, in the order of their starts; inner tags are stripped, entities stay.

    Text belongs to the innermost open block, so an item's text after a nested list is the item's; a table has the text of all its
    cells, whatever is in them. As browsers do, a block's start ends an open paragraph, an item ends the one before it, and a
    container's end ends what is open inside. Scripts, styles, templates and comments have no text.
    """
    html, at = html or "", 0
    out: list[tuple[str, list[str]]] = []
    open_: list[tuple[str, list[str] | None]] = []  # open blocks, a region's with its text
    into: list[str] | None = None

    def close(tag: str, walls: set[str]) -> None:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == tag:
                del open_[i:]
                return
            if open_[i][0] in walls:
                return

    for m in MARKUP.finditer(html):
        if into is not None:
            into.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if into is not None and (tag in ("br", "hr") or tag in CONTAINERS or tag in REGION_TAGS):
            into.append(" ")
        if tag not in CONTAINERS and tag not in REGION_TAGS:
            continue
        if m[2]:
            close(tag, set() if tag in ("html", "body", "table") else {"table"} if tag in CELLS else {"table", "td", "th"})
        else:
            close("p", {"table", "td", "th", "li"})
            if tag == "li":
                close("li", {"table", "td", "th", "ul", "ol", "menu"})
            region = None
            if tag in REGION_TAGS and not any(t == "table" for t, _ in open_):
                region = []
                out.append((tag, region))
            open_.append((tag, region))
        tables = [text for t, text in open_ if t == "table"]
        into = tables[0] if tables else next((text for _, text in reversed(open_) if text is not None), None)
    if into is not None:
        into.append(html[at:])
    texts = [(tag, re.sub("  +", " ", "".join(parts)) if " " in parts else "".join(parts)) for tag, parts in out]
    return [(tag, text.strip()) for tag, text in texts if text.strip()]


def html_regions(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, region_type, heading_level, content): headings, paragraphs, list items and tables with text, in order; see regions_of()."""
    kind = pages.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [(n, k, tag, text) for n, html in enumerate(part.column(1).to_pylist()) for k, (tag, text) in enumerate(regions_of(html))]
                if rows:
                    n, k, tag, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"page_id": part.column(0).take(pa.array(n, pa.int64())), "ordinal": pa.array(k, pa.int32()), "tag": pa.array(tag, pa.string()), "content": pa.array(text, pa.string())})

    rows = pages.select("page_id", "html").mapInArrow(run, f"page_id {kind.simpleString()}, ordinal int, tag string, content string")
    tag = F.col("tag")
    kinds = F.when(tag.startswith("h"), "heading").when(tag == "li", "list").when(tag == "table", "table").otherwise("paragraph")
    return rows.select("page_id", "ordinal", kinds.alias("region_type"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("heading_level"), "content")


def parents(regions: DataFrame, group: str = "page_id") -> DataFrame:
    """With `parent`: the nearest earlier heading, of a lower level where the region is a heading itself."""
    before = Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce("heading_level", F.lit(7))
    last = [F.when(own > level, F.last(F.when(F.col("heading_level") == level, F.col("ordinal")), ignorenulls=True).over(before)) for level in range(1, 7)]
    return regions.withColumn("parent", F.greatest(*last))


def heading_paths(regions: DataFrame, group: str = "page_id", depth: int = 6) -> DataFrame:
    """(group, ordinal, path): headings above each region, root first. regions: with parents()."""
    heads = regions.where(F.col("heading_level").isNotNull()).select(group, F.col("ordinal").alias("h"), F.col("parent").alias("hp"), F.col("content").alias("hc"))
    rows = regions.select(group, "ordinal", F.col("parent").alias("up"), F.array().cast("array<string>").alias("path"))
    for _ in range(depth):  # levels are 1 to 6
        rows = rows.join(heads, (rows[group] == heads[group]) & (rows["up"] == heads["h"]), "left").select(rows[group], "ordinal", F.col("hp").alias("up"), F.when(F.col("hc").isNotNull(), F.concat(F.array("hc"), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return rows.drop("up")


def neighbours(regions: DataFrame, group: str = "page_id") -> DataFrame:
    """(group, ordinal, nearby): the regions just before and after, joined; reading order is dense within a page."""
    w = Window.partitionBy(group).orderBy("ordinal")
    return regions.select(group, "ordinal", T.joined_context([F.lag("content").over(w), F.lead("content").over(w)]).alias("nearby"))


def related(relations: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, other, relation): the other ends of relations (source, target, relation) at either end of regions (region), where that end is a region too."""
    ends = regions.select("region")
    both = relations.select(F.col("source").alias("region"), F.col("target").alias("other"), "relation").unionByName(relations.select(F.col("target").alias("region"), F.col("source").alias("other"), "relation"))
    return both.join(ends, "region", "left_semi").join(ends.withColumnRenamed("region", "other"), "other", "left_semi").select("region", "other", "relation").distinct()


def captions(regions: DataFrame, document: str = "document", surface: str = "surface") -> DataFrame:
    """(document, region, target, relation, confidence): captions to the nearest earlier visual region of their surface, and other regions to the figures that they name (of equal numbers the last caption's)."""
    before = Window.partitionBy(document, surface).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("region_type").isin("image", "chart", "table"), F.col("ordinal")), ignorenulls=True).over(before)
    caption = F.col("region_type") == "caption"
    of = regions.withColumn("target", seen).where(caption & F.col("target").isNotNull()).select(document, F.col("ordinal").alias("region"), "target", "content")
    figures = of.withColumn("n", T.figure_numbers(F.col("content"))[0]).where(F.col("n").isNotNull()).groupBy(document, "n").agg(F.max_by("target", "region").alias("target"))
    said = regions.where(~caption).select(document, F.col("ordinal").alias("region"), F.explode(T.figure_numbers(F.col("content"))).alias("n"))
    named = said.join(figures, [document, "n"]).where("region <> target").select(document, "region", "target", F.lit("references").alias("relation"), F.lit(0.85).alias("confidence"))
    return of.select(document, "region", "target", F.lit("caption_of").alias("relation"), F.lit(0.9).alias("confidence")).unionByName(named)


def continued_tables(regions: DataFrame, document: str, surface: str) -> DataFrame:
    """(document, region, target): a table at the head of a surface (top at most .25) goes on from the last one of the surface before it, if that ends at its foot (bottom .75 or more). regions: with top and bottom."""
    t = regions.where(F.col("region_type") == "table")
    last = t.groupBy(document, (F.col(surface) + 1).alias(surface)).agg(F.max_by(F.struct("ordinal", "bottom"), "ordinal").alias("last"))
    both = t.select(document, surface, "ordinal", "top").join(last, [document, surface])
    return both.where((F.col("top") <= 0.25) & (F.col("last.bottom") >= 0.75)).select(document, F.col("ordinal").alias("region"), F.col("last.ordinal").alias("target"))


def representations(regions: DataFrame, summary: Column, group: str = "page_id") -> DataFrame:
    """(group, ordinal, kind, content, place): text if there is any, a caption where a summary says more, and a visual for tables, charts and images."""
    text, visual = F.col("content"), F.col("region_type").isin("image", "chart", "table")
    each = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("text").alias("kind"), text.alias("body"), (text != "").alias("use")),
        F.struct(F.lit(1).alias("k"), F.lit("caption").alias("kind"), summary.alias("body"), (summary.isNotNull() & ~summary.eqNullSafe(text)).alias("use")),
        F.struct(F.lit(2).alias("k"), F.lit("visual").alias("kind"), F.coalesce(summary, text).alias("body"), visual.alias("use")),
    )
    rows = regions.select(group, "ordinal", F.explode(F.filter(each, lambda r: r["use"])).alias("r"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("ordinal", "r.k")) - 1
    return rows.select(group, "ordinal", F.col("r.kind").alias("kind"), F.col("r.body").alias("content"), place.alias("place"))


def tiles(images: DataFrame) -> DataFrame:
    """(id, tile, x0, y0, x1, y1): one whole tile up to 2048 a side, else 1024-pixel tiles, row by row, cut at the edges."""
    whole = F.greatest("width", "height") <= WHOLE
    steps = lambda n: F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(TILE)))
    rows = images.select("id", "width", "height", whole.alias("whole"), F.explode(steps(F.col("height"))).alias("y0")).select("*", F.explode(steps(F.col("width"))).alias("x0"))
    end = lambda at, n: F.when(F.col("whole"), n).otherwise(F.least(n, at + TILE))
    tile = F.when(F.col("whole"), 0).otherwise((F.col("y0") / TILE).cast("int") * F.ceil(F.col("width") / TILE).cast("int") + (F.col("x0") / TILE).cast("int"))
    return rows.select("id", tile.alias("tile"), "x0", "y0", end(F.col("x0"), F.col("width")).alias("x1"), end(F.col("y0"), F.col("height")).alias("y1"))


def image_regions(images: DataFrame) -> DataFrame:
    """tiles() as regions: (id, ordinal, region_type, bbox, requires_vision), boxes as shares of the image; an image's surface is always complex."""
    rows = tiles(images).join(images.select("id", "width", "height"), "id")
    box = F.array(F.col("x0") / F.col("width"), F.col("y0") / F.col("height"), F.col("x1") / F.col("width"), F.col("y1") / F.col("height"))
    return rows.select("id", F.col("tile").alias("ordinal"), F.lit("image").alias("region_type"), box.alias("bbox"), F.lit(True).alias("requires_vision"))


def page_regions(blocks: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """(page, ordinal, region_type, content, parent, complex): pages assembled from blocks (page, reading_order, region_type, content) and what else is on them (page, images, tables, drawings, columns).

    Regions are numbered in reading order; a region's parent is the last heading before it on its page, a heading has none. A page is
    complex without blocks, with an image or a table, with more than MOST_DRAWINGS drawings, or with two columns. A page without
    blocks is one image region.
    """
    before = Window.partitionBy(page).orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    ordinal = (F.row_number().over(Window.partitionBy(page).orderBy("reading_order")) - 1).alias("ordinal")
    rows = blocks.select(page, "reading_order", "region_type", "content", ordinal)
    above = F.last(F.when(F.col("region_type") == "heading", F.col("ordinal")), ignorenulls=True).over(before)
    rows = rows.select(page, "ordinal", "region_type", "content", F.when(F.col("region_type") != "heading", above).alias("parent"))
    none = F.col("ordinal").isNull()
    busy = none | (F.col("images") > 0) | (F.col("tables") > 0) | (F.col("drawings") > MOST_DRAWINGS) | (F.col("columns") > 1)
    whole = pages.join(rows, page, "left")
    return whole.select(page, F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.when(none, "image").otherwise(F.col("region_type")).alias("region_type"), F.coalesce("content", F.lit("")).alias("content"), "parent", busy.alias("complex"))


def active_regions(regions: DataFrame, documents: DataFrame) -> DataFrame:
    """regions (document, generation, ...) of each document's active generation; documents: (document, active)."""
    both = regions.join(documents.select("document", "active"), "document")
    return both.where(F.col("generation").eqNullSafe(F.col("active"))).drop("active")


SPACES = np.array([chr(i).isspace() for i in range(0x3001)])  # no white space lies beyond


def _breaks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where text may be cut, in order, the strength of each, and where words begin.

    Strengths: 0 after white space, 1 after a line, 2 after a sentence (its mark and the space or line end that follows), 3 after a paragraph.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space, line = SPACES[np.minimum(codes, len(SPACES) - 1)], codes == 10
    space &= codes < len(SPACES)
    strength = np.where(line, 1, np.where(space, 0, -1)).astype(np.int8)
    mark = (codes == 46) | (codes == 33) | (codes == 63)
    strength[1:][mark[:-1] & (line | (codes == 32))[1:]] = 2
    strength[1:][line[:-1] & line[1:]] = 3
    at = np.flatnonzero(strength >= 0) + 1
    return at, strength[at - 1], at[~np.append(space, False)[at]]


def cut_text(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, piece): pieces of at most `size` characters of the text without outer white space; blank ones drop out, and offsets are places in the whole text.

    A piece ends at the strongest break in the last LOOK_BACK of its window, the last of equals: a paragraph's end, a sentence's, a
    line's, white space; without any, at its window's end. A break counts where all of it lies in that last part. The next piece begins `overlap` before that end, or, inside a word, at
    the next word, but never past that end, nor before the place where the last piece began.
    """
    text = text or ""
    lead = len(text) - len(text.lstrip())
    text = text.strip()
    at, strength, starts = _breaks(text) if len(text) > size else (np.zeros(0, np.int64),) * 3
    pieces, begin = [], 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            earliest = max(begin + 1, end - max(1, int(size * LOOK_BACK)))
            lo, hi = np.searchsorted(at, earliest, "right"), np.searchsorted(at, end, "right")
            if lo < hi:
                held = strength[lo:hi].copy()
                if at[lo] == earliest + 1:  # of two characters one would lie before the window
                    held[0] = min(held[0], text[earliest] == "\n")
                end = int(at[lo:hi][np.flatnonzero(held == held.max())[-1]])
        pieces.append((lead + begin, text[begin:end]))
        if end == len(text):
            break
        back = end - overlap
        if back > 0 and not text[back - 1].isspace():
            k = np.searchsorted(starts, back)
            back = min(end, int(starts[k])) if k < len(starts) else end
        begin = back if back > begin else end
    return [(i, piece.strip()) for i, piece in pieces if piece.strip()]


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ordinal, start, content) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = [(key, k, at, piece) for key, text in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True) for k, (at, piece) in enumerate(cut_text(text, size, overlap))]
                if rows:
                    key, k, at, piece = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(key, pa.int64()), "ordinal": pa.array(k, pa.int32()), "start": pa.array(at, pa.int32()), "content": pa.array(piece, pa.string())})

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, ordinal int, start int, content string")
