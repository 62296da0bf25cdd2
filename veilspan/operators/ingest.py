"""From files or pages of lines to a text with geometry, and from ranges back to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.functions.spans import counted, hull, plus, running
from veilspan.operators.geometry import overlapping

MAX_BYTES = 52_428_800
READABLE = r"[^\p{IsLatin}0-9!-/:-@\[-`{-~«»°€£§·•–—‘’‚“”„…′″±½¼¾¹²³µ©®™]"


def looks_like_pdf(content: Column) -> Column:
    """The header within the first 1024 bytes."""
    return F.position(F.lit("255044462D"), F.hex(F.substring(content, 1, 1024))) % 2 == 1


def classify_file(size: Column, head: Column) -> Column:
    return F.when(size > MAX_BYTES, F.lit("tooLarge")).when(~looks_like_pdf(head), F.lit("notPdf"))


def classify_pages(pages: DataFrame) -> DataFrame:
    """doc_id, support and pages_without_text of (doc_id, page, has_text); documents without pages are null pages."""
    p = pages.groupBy("doc_id").agg(
        F.count("page").alias("n"), F.count_if("has_text").alias("k"), F.sort_array(F.collect_list(F.when(~F.col("has_text"), F.col("page")))).alias("without")
    )
    support = F.when(F.col("n") == 0, "invalid").when(F.col("k") == 0, "imageOnly").when(F.col("k") < F.col("n"), "partiallySupported").otherwise("supported")
    return p.select("doc_id", support.alias("support"), F.when(support == "partiallySupported", F.col("without")).otherwise(F.array().cast("array<int>")).alias("pages_without_text"))


def is_unreadable(line: Column) -> Column:
    """At least 3 and at least 30 % of the visible characters are not expected in a document."""
    visible = F.length(F.regexp_replace(line, r"\s+", ""))
    odd = F.length(F.regexp_replace(line, r"\s+", "")) - F.length(F.regexp_replace(F.regexp_replace(line, r"\s+", ""), READABLE, ""))
    return (odd >= 3) & (odd >= 0.3 * visible)


def lines_of(docs: DataFrame, page_lines: int = 40) -> DataFrame:
    """(doc_id, page, line, text): texts cut at newlines, page_lines lines on a page."""
    x = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))
    return x.select("doc_id", F.expr(f"cast(i div {page_lines} as int)").alias("page"), F.expr(f"cast(i % {page_lines} as int)").alias("line"), "text")


def separate_unreadable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that can be read, and the others."""
    return lines.where(~is_unreadable(F.col("text"))), lines.where(is_unreadable(F.col("text")))


def spans_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, start, end, text): where each line is in the joined text; empty lines have no span.

    Lines are joined by a newline, pages by a form feed, so each line but the first adds one character.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    s = lines.withColumn("_n", F.length("text"))  # so that the texts are not sorted if nobody reads them
    before = F.coalesce(F.sum(F.col("_n") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("start", before.cast("int"))
    return s.withColumn("end", (F.col("start") + F.col("_n")).cast("int")).where("_n > 0").select("doc_id", "page", "line", "start", "end", "text")


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of lines: the canonical text."""
    pages = lines.groupBy("doc_id", "page").agg(F.expr("array_join(transform(sort_array(collect_list(struct(line, text))), x -> x.text), '\n')").alias("t"))
    return pages.groupBy("doc_id").agg(F.expr("array_join(transform(sort_array(collect_list(struct(page, t))), x -> x.t), '\f')").alias("text"))


def fixed_glyphs(first: str, end: str) -> str:
    """SQL: the boxes of glyphs first to end of a line on a fixed-width page: glyph i of line j at x 10 + 5 i, y 10 + 12 j, 5 by 12."""
    return f"transform(sequence({first}, {end} - 1), i -> struct(10D + 5 * i as x, 10D + 12 * line as y, 5D as w, 12D as h))"


def fixed_boxes(spans: DataFrame) -> DataFrame:
    """spans with char_boxes of a fixed-width page."""
    return spans.withColumn("char_boxes", F.expr(fixed_glyphs("0", "end - start")))


def fixed_lines(spans: DataFrame) -> DataFrame:
    """spans with box, the hull of their glyphs on a fixed-width page."""
    return spans.withColumn("box", F.expr("struct(10D as x, 10D + 12 * line as y, 5D * (end - start) as w, 12D as h)"))


def areas_for(spans: DataFrame, ranges: DataFrame, glyphs=None) -> DataFrame:
    """(doc_id, range_id, page, line, box): a hull box for each line that a range (doc_id, range_id, r_start, r_end) touches.

    The spans bring char_boxes, or glyphs gives SQL for the boxes of a line's glyphs from one place to
    another; then only those of the places that are touched are made, and none of them is shuffled.
    """
    own = spans.select("doc_id", "page", "line", "start", "end", *(() if glyphs else ("char_boxes",)))
    j = overlapping(ranges.select("doc_id", "range_id", "r_start", "r_end"), own, ["doc_id"], ("r_start", "r_end"), ("start", "end"))
    first, last = "greatest(r_start - start, 0)", "least(r_end, end) - start"
    part = glyphs(first, last) if glyphs else f"slice(char_boxes, {first} + 1, {last} - {first})"
    box = f"""transform(array({part}), b -> struct(array_min(transform(b, k -> k.x)) as x, array_min(transform(b, k -> k.y)) as y,
        array_max(transform(b, k -> k.x + k.w)) - array_min(transform(b, k -> k.x)) as w, array_max(transform(b, k -> k.y + k.h)) - array_min(transform(b, k -> k.y)) as h))[0]"""
    return j.select("doc_id", "range_id", "page", "line", F.expr(box).alias("box"))


def lines_in(text: Column, page_lines: int = 40) -> Column:
    """array<struct<page,line,start,end>>: the spans of `spans_of` in the row of their text."""
    sizes = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), F.length)
    line = lambda size, after, i: F.struct(
        F.floor(i / page_lines).cast("int").alias("page"), (i % page_lines).alias("line"), (after - 1 - size).alias("start"), (after - 1).alias("end")
    )
    zipped = lambda s: F.arrays_zip(s.alias("size"), running(F.transform(s, lambda n: n + 1), plus).alias("after"))
    placed = F.transform(F.array(sizes), lambda s: F.transform(zipped(s), lambda x, i: line(x["size"], x["after"], i)))[0]
    return F.filter(placed, lambda x: x["end"] > x["start"])


def fixed_hull(line: Column, first: Column, end: Column) -> Column:
    """The hull of glyphs first to end of a line on a fixed-width page."""
    return F.struct((F.lit(10.0) + 5 * first).alias("x"), (F.lit(10.0) + 12 * line).alias("y"), (F.lit(5.0) * (end - first)).alias("w"), F.lit(12.0).alias("h"))


def areas_in(lines: Column, ranges: Column, box) -> Column:
    """array<struct<range_id,page,line,box>>: the areas of `areas_for` in the row of a document, from the arrays of its lines and of (range_id, start, end).

    box: the hull of a line's glyphs from one place to another. The lines of a range are looked up by bisection.
    """

    def of(ls: Column, rs: Column) -> Column:
        starts = F.transform(ls, lambda x: x["start"])
        found = lambda at: counted(starts, F.transform(rs, at))
        zipped = F.arrays_zip(rs.alias("r"), found(lambda r: r["start"]).alias("first"), found(lambda r: r["end"] - 1).alias("last"))
        return F.flatten(F.transform(F.filter(zipped, lambda z: z["r"]["end"] > z["r"]["start"]), lambda z: touched(ls, z["r"], F.greatest(z["first"], F.lit(1)), z["last"])))

    def touched(ls: Column, r: Column, first: Column, last: Column) -> Column:
        own = F.filter(F.slice(ls, first, F.greatest(last - first + 1, F.lit(0))), lambda x: x["end"] > r["start"])
        return F.transform(own, lambda x: F.struct(
            r["range_id"].alias("range_id"), x["page"].alias("page"), x["line"].alias("line"),
            box(x["line"], F.greatest(r["start"], x["start"]) - x["start"], F.least(r["end"], x["end"]) - x["start"]).alias("box"),
        ))

    return F.transform(F.arrays_zip(F.array(lines).alias("ls"), F.array(ranges).alias("rs")), lambda b: of(b["ls"], b["rs"]))[0]


def page_of(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, range_id, page): the page of the first span that a range overlaps."""
    j = overlapping(ranges.select("doc_id", "range_id", "r_start", "r_end"), spans, ["doc_id"], ("r_start", "r_end"), ("start", "end"))
    return j.groupBy("doc_id", "range_id").agg(F.min_by("page", "start").alias("page"))


def unreadable_zones(lines_with_boxes: DataFrame) -> DataFrame:
    """(doc_id, page, line, box): the hull of the glyphs of lines that cannot be read (doc_id, page, line, text, box per glyph)."""
    bad = lines_with_boxes.where(is_unreadable(F.col("text"))).select("doc_id", "page", "line", F.explode("char_boxes").alias("b"))
    return bad.groupBy("doc_id", "page", "line").agg(hull(F.col("b")).alias("box"))
