"""Structure of texts and pages: blocks of Markdown, lines and blocks of placed words, reading order, merged vision results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
REGION_TYPES = ["heading", "paragraph", "list", "code", "table", "chart", "image", "caption", "footnote"]
HEADING = r"(?d)^(#{1,6})\s+(.+?)\s*$"
LIST_LINE = r"^\s*(?:[-*+] |\d+[.)] )"
LINE_GAP = 4  # points between lines
HEADING_SIZE, HEADING_CHARS = 1.25, 160  # of the page's typical type
FOOT, FOOT_SIZE = 0.86, 0.9  # of the page's height, of the typical type
SAME_LEFT, SAME_BLOCK = 0.035, 0.025  # of the page
NARROW, LEFT_END, RIGHT_START = 0.55, 0.58, 0.42  # of the page's width
CAPTION = r"(?i)^(figure|fig\.|table)\s+\d+"


def text_blocks(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, ordinal, text_start, text_end, content): blocks of texts (key, text) between blank lines, without outer white space. Offsets count characters from 0."""
    gap = r"\n\s*\n"
    parts = F.arrays_zip(F.split("text", gap).alias("part"), F.regexp_extract_all("text", F.lit(f"({gap})"), F.lit(1)).alias("gap"))
    before = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.select(key, F.posexplode(parts).alias("nth", "p")).select(key, "nth", F.col("p.part").alias("part"), (F.length("p.part") + F.coalesce(F.length("p.gap"), F.lit(0))).alias("size"))
    content = F.regexp_replace("part", r"^\s+|\s+$", "")
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^\s+", ""))
    rows = rows.withColumns({"content": content, "text_start": F.coalesce(F.sum("size").over(before), F.lit(0)) + lead}).where("content <> ''")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("nth")) - 1
    return rows.select(key, ordinal.alias("ordinal"), "text_start", (F.col("text_start") + F.length("content")).alias("text_end"), "content")


def markdown_regions(texts: DataFrame, key: str = "id") -> DataFrame:
    """text_blocks() of Markdown with region_type and heading_level; headings' content without their marks."""
    lines = F.filter(F.split("content", r"\n"), lambda x: F.trim(x) != "")
    heading = F.col("content").rlike(HEADING)
    kind = F.when(heading, "heading").when(F.col("content").startswith("```"), "code").when(F.forall(lines, lambda x: F.rlike(x, F.lit(LIST_LINE))), "list").otherwise("paragraph")
    level = F.when(heading, F.length(F.regexp_extract("content", HEADING, 1)))
    body = F.when(heading, F.regexp_extract("content", HEADING, 2)).otherwise(F.col("content"))
    return text_blocks(texts, key).select(key, "ordinal", kind.alias("region_type"), level.alias("heading_level"), "text_start", "text_end", body.alias("content"))


def runs(rows: DataFrame, keys: list[str], order: list[str], name: str, step: Callable[[tuple | None, tuple], tuple[tuple, bool]], fields: list[str]) -> DataFrame:
    """rows with a column `name` that numbers runs within keys, in order. step(state, values of fields) gives the state and whether a new run begins; the state is None at a key's first row.

    Tasks stream through sorted partitions and hold one state.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} int"
    at_keys, at_fields = [rows.columns.index(k) for k in keys], [rows.columns.index(f) for f in fields]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n = None, None, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                key = tuple(r[i] for i in at_keys)
                if key != now:
                    now, state, n = key, None, -1
                state, new = step(state, tuple(r[i] for i in at_fields))
                n += new or n < 0
                out.append(n)
            yield b.assign(**{name: out})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(number, schema)


def _numbers(column: pa.Array, null: float) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _whole_lines(rows: pa.Table, starts: list[int], numbers: list[int], typical: list[float], names: list[str]) -> pa.RecordBatch:
    """Words (page, side, top, x0, x1, bottom, size, width, height, text) as a row a line; a line's least and greatest values leave nulls out, as Spark's do."""
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    at = np.asarray(starts, np.int64)
    own = np.repeat(np.arange(len(at)), np.diff([*starts, len(rows)]))
    order = np.lexsort((_numbers(column("top"), -np.inf), _numbers(column("x0"), -np.inf), own))  # words alike in both stay in the order of their text
    text = column("text").take(pa.array(order))
    there = text.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(there, at, dtype=np.int64))]).astype(np.int32)
    content = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text.drop_null()), " ")

    def fold(name: str, least: bool) -> pa.Array:
        v = np.fmin.reduceat(_numbers(column(name), np.nan), at) if least else np.maximum.reduceat(_numbers(column(name), -np.inf), at)
        none = np.add.reduceat(column(name).is_valid().to_numpy(zero_copy_only=False), at, dtype=np.int64) == 0
        return pa.array(v, mask=none)

    first = lambda name: column(name).take(pa.array(at))
    held = [first("page"), pa.array(numbers, pa.int32()), content, fold("x0", True), fold("top", True), fold("x1", False), fold("bottom", False), fold("size", False), first("width"), first("height"), pa.array(typical, pa.float64())]
    return pa.RecordBatch.from_arrays(held, names=names).filter(pc.equal(first("side"), 1))


def _in_lines(names: list[str]):
    """Rows sorted by page, side (0: the page's typical size, 1: a word) and place; a task holds the words of a batch and of the line that it leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows, open_line, now = [], None, ()  # the open line's number, first top and page's typical size
        for b in filter(len, batches):
            pages = b.column(0).dictionary_encode("encode").indices.to_numpy()
            new = np.concatenate([[(b.column(0)[0].as_py(),) != now], pages[1:] != pages[:-1]])
            now = (b.column(0)[b.num_rows - 1].as_py(),)
            number, first, typical = open_line or (-1, 0.0, 0.0)
            starts, lines = [], []
            side, tops = b.column(1).to_numpy(), _numbers(b.column(2), np.nan)
            bucket = np.rint(tops / LINE_GAP)
            cuts = np.flatnonzero(np.concatenate([[True], (new[1:] | (side[1:] != side[:-1]) | (bucket[1:] != bucket[:-1]))]))  # words between cuts are hardly ever told apart
            least, most = np.minimum.reduceat(tops, cuts).tolist(), np.maximum.reduceat(tops, cuts).tolist()
            for lo, hi, low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)], least, most, strict=True):
                if new[lo] or number < 0:
                    if new[lo]:
                        number, typical = int(side[lo]) - 1, 0.0 if side[lo] else b.column(6)[lo].as_py()
                    else:
                        number = 0
                    first = float(tops[lo])
                    starts.append(lo)
                    lines.append((number, first, typical))
                if abs(low - first) > LINE_GAP or abs(high - first) > LINE_GAP:
                    for i, top in enumerate(tops[lo:hi].tolist(), lo):
                        if abs(top - first) > LINE_GAP:
                            number, first = number + 1, top
                            starts.append(i)
                            lines.append((number, first, typical))
            if starts:
                before = sum(map(len, open_rows))
                done = [*([(0, open_line)] if before else []), *((before + i, line) for i, line in zip(starts[:-1], lines[:-1], strict=True))]
                rows = [*open_rows, b.slice(0, starts[-1])]
                if done:
                    yield _whole_lines(pa.Table.from_batches(rows), [i for i, _ in done], [x[0] for _, x in done], [x[2] for _, x in done], names)
                open_rows, open_line = [b.slice(starts[-1])], lines[-1]
            else:
                open_rows.append(b)
        if open_rows:
            yield _whole_lines(pa.Table.from_batches(open_rows), [0], [open_line[0]], [open_line[2]], names)

    return run


def page_lines(words: DataFrame, page: str = "page") -> DataFrame:
    """(page, line, content, x0, top, x1, bottom, region_type): words (page, text, x0, top, x1, bottom, size, width, height) in lines.

    A word more than 4 below or above its line's first word begins a new line. Boxes are shares of the page. A caption's pattern
    comes before a footnote's small type at the foot, and that before a heading's large type. Words are shuffled once, each page's
    typical size goes ahead of them, and tasks stream through them and give out whole lines.
    """
    numbers = ["top", "x0", "x1", "bottom", "size", "width", "height"]
    rows = words.select(F.col(page).alias("page"), F.lit(1).alias("side"), *[F.col(c).cast("double").alias(c) for c in numbers], F.col("text").cast("string").alias("text"), F.bround(F.col("top") / LINE_GAP).cast("double").alias("bucket"))
    sizes = words.where("size > 0").where(F.col(page).isNotNull()).groupBy(F.col(page).alias("page"), F.col("size").cast("double").alias("size")).agg(F.count("*").alias("n"))
    typical = sizes.groupBy("page").agg(F.percentile("size", F.lit(0.5), F.col("n")).alias("size")).withColumn("side", F.lit(0))
    placed = rows.unionByName(typical, allowMissingColumns=True).repartition("page").sortWithinPartitions("page", "side", "bucket", "x0", "top", "text").drop("bucket")
    names = [page, "line", "content", "x0", "top", "x1", "bottom", "size", "width", "height", "typical"]
    kind = rows.schema["page"].dataType.simpleString()
    lines = placed.mapInArrow(_in_lines(names), f"`{page}` {kind}, line int, content string, " + ", ".join(f"{c} double" for c in names[3:]))
    lines = lines.withColumn("content", F.trim("content")).where("content <> ''")
    size = F.coalesce("size", F.lit(0.0))
    heading = (F.col("typical") > 0) & (size >= F.col("typical") * HEADING_SIZE) & (F.length("content") <= HEADING_CHARS)
    foot = (F.col("top") > F.col("height") * FOOT) & (size > 0) & (size < F.col("typical") * FOOT_SIZE)
    kind = F.when(F.col("content").rlike(CAPTION), "caption").when(foot, "footnote").when(heading, "heading").otherwise("paragraph")
    share = lambda c, whole: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.col(whole)))
    return lines.select(page, "line", "content", share("x0", "width").alias("x0"), share("top", "height").alias("top"), share("x1", "width").alias("x1"), share("bottom", "height").alias("bottom"), kind.alias("region_type"))


def page_blocks(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, block, content, x0, top, x1, bottom, region_type): paragraphs' lines that begin at about the same place and follow closely are one block."""

    def step(last: tuple | None, line: tuple) -> tuple[tuple, bool]:
        kind, x0, top, bottom = line
        if last and kind == last[0] == "paragraph" and abs(x0 - last[1]) < SAME_LEFT and top - last[2] < SAME_BLOCK:
            return (kind, min(x0, last[1]), bottom), False
        return (kind, x0, bottom), True

    rows = runs(lines, [page], ["line"], "block", step, ["region_type", "x0", "top", "bottom"])
    placed = F.array_sort(F.collect_list(F.struct("line", "content", "top", "bottom")))
    out = rows.groupBy(page, "block").agg(placed.alias("p"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("region_type").alias("region_type"))
    return out.select(page, "block", F.array_join(F.transform("p", lambda r: r["content"]), " ").alias("content"), "x0", F.col("p")[0]["top"].alias("top"), "x1", F.element_at("p", -1)["bottom"].alias("bottom"), "region_type")


def reading_order(blocks: DataFrame, page: str = "page", tie: str = "block") -> DataFrame:
    """blocks (page, x0, top, x1) with `reading_order` from 0: on two-column pages full-width blocks, then the left column, then the right; else from the top."""
    whole = Window.partitionBy(page)
    narrow = F.col("x1") - F.col("x0") < NARROW
    left, right = F.coalesce(F.bool_or(narrow & (F.col("x1") <= LEFT_END)).over(whole), F.lit(False)), F.coalesce(F.bool_or(narrow & (F.col("x0") >= RIGHT_START)).over(whole), F.lit(False))
    columns = left & right & (F.count("*").over(whole) > 1)
    part = F.when(~columns | ~narrow, 0).when((F.col("x0") + F.col("x1")) / 2 < 0.5, 1).otherwise(2)
    side = F.when(columns, 0.0).otherwise(F.col("x0"))
    rows = blocks.withColumns({"_part": part, "_side": side})
    return rows.withColumn("reading_order", F.row_number().over(whole.orderBy("_part", "top", "_side", tie)) - 1).drop("_part", "_side")


PAYLOAD = "struct<regions: array<struct<local_ordinal: int, type: string, bbox: array<double>, content: string, summary: string>>>"


def vision_box(box: Column) -> Column:
    """[y0, x0, y1, x1] in thousandths as sorted [x0, y0, x1, y1] in [0, 1]."""
    v = F.transform(box, lambda x: F.least(F.lit(1000.0), F.greatest(F.lit(0.0), x)) / 1000)
    return F.array(F.least(v[1], v[3]), F.least(v[0], v[2]), F.greatest(v[1], v[3]), F.greatest(v[0], v[2]))


def merge_vision(regions: DataFrame, payloads: DataFrame, page: str = "page_id") -> DataFrame:
    """regions (page, ordinal, region_type, content) with what payloads (page, payload: JSON) say: all of a page's items or, if any is bad, none.

    Text that is there is never replaced. Adds bbox, summary and source (local, vision or merged); of repeated items the last holds.
    """
    items = payloads.select(page, F.posexplode(F.from_json("payload", PAYLOAD)["regions"]).alias("nth", "r")).select(page, "nth", "r.*")
    known = regions.select(page, F.col("ordinal").alias("local_ordinal"), F.lit(True).alias("known"))
    boxes = F.coalesce(F.size("bbox") == 4, F.lit(False)) & ~F.exists(F.coalesce("bbox", F.array().cast("array<double>")), lambda x: x.isNull())
    good = F.coalesce(F.col("known") & F.col("type").isin(REGION_TYPES) & boxes, F.lit(False))
    items = items.join(known, [page, "local_ordinal"], "left").withColumn("_good", good)
    items = items.withColumn("_all", F.min("_good").over(Window.partitionBy(page))).where("_all")
    nth = F.row_number().over(Window.partitionBy(page, "local_ordinal").orderBy(F.col("nth").desc()))
    items = items.withColumn("_nth", nth).where("_nth = 1").select(page, F.col("local_ordinal").alias("ordinal"), F.col("type").alias("_type"), vision_box(F.col("bbox")).alias("bbox"), F.trim(F.coalesce("content", F.lit(""))).alias("_content"), F.nullif(F.trim(F.coalesce("summary", F.lit(""))), F.lit("")).alias("summary"))
    own = F.trim("content") != ""
    body = F.when(own | F.col("_content").isNull(), F.col("content")).otherwise(F.col("_content"))
    source = F.when(F.col("_type").isNull(), "local").when(own, "merged").otherwise("vision")
    return regions.join(items, [page, "ordinal"], "left").select(page, "ordinal", F.coalesce("_type", "region_type").alias("region_type"), body.alias("content"), "bbox", "summary", source.alias("source"))


def surfaces_to_enrich(surfaces: DataFrame, limit: int = 20) -> DataFrame:
    """Of each document's complex surfaces (document, surface, complex, enriched) that are not enriched yet, the first `limit`."""
    rows = surfaces.where("complex AND NOT enriched")
    nth = F.row_number().over(Window.partitionBy("document").orderBy("surface"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
