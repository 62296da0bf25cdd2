"""Proof of removal: checks over the output, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import needles
from veilspan.functions.spans import boxes_intersect, hull
from veilspan.operators.geometry import points_in


def valid_counts(expected: Column, independent: Column, inspected: Column) -> Column:
    return F.coalesce((expected == independent) & (expected == inspected), F.lit(False))


def text_absent(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """Failures (doc_id, page, text_index): pages (doc_id, page, n) that still hold a text of the plan (doc_id, texts)."""
    j = pages.select("doc_id", "page", "n").join(plans.select("doc_id", "texts"), "doc_id").withColumn("hits", needles.places(F.col("n"), F.col("texts")))
    return j.select("doc_id", "page", F.explode(F.expr("array_distinct(transform(hits, h -> h.needle))")).alias("text_index")).distinct()


def glyphs_near(spans: DataFrame, areas: DataFrame, glyphs: str = "char_boxes") -> DataFrame:
    """(doc_id, page, box) of the glyphs that an area of their page can hold: their centres are within the hull of its areas.

    glyphs: SQL over a span for the boxes of its glyphs. Spans may bring box, the hull of their
    glyphs; the glyphs of spans that are away from all areas are then not made at all.
    """
    near = areas.groupBy("doc_id", "page").agg(hull(F.col("box")).alias("_near"))
    s = spans.join(near, ["doc_id", "page"])
    if "box" in spans.columns:
        s = s.where(boxes_intersect(F.col("box"), F.col("_near")))
    centre = "b.x + b.w / 2 > _near.x and b.x + b.w / 2 < _near.x + _near.w and b.y + b.h / 2 > _near.y and b.y + b.h / 2 < _near.y + _near.h"
    return s.select("doc_id", "page", F.explode(F.expr(f"filter({glyphs}, b -> {centre})")).alias("box"))


def geometry(glyphs: DataFrame, areas: DataFrame) -> DataFrame:
    """Failures (doc_id, page): a glyph's centre is strictly inside an area of its page (both: doc_id, page, box)."""
    g = glyphs.select("doc_id", "page", (F.col("box.x") + F.col("box.w") / 2).alias("cx"), (F.col("box.y") + F.col("box.h") / 2).alias("cy"))
    a = areas.select("doc_id", "page", F.col("box.x").alias("x0"), F.col("box.y").alias("y0"), (F.col("box.x") + F.col("box.w")).alias("x1"), (F.col("box.y") + F.col("box.h")).alias("y1"))
    return points_in(g, a, ["doc_id", "page"], "cx", "cy").select("doc_id", "page").distinct()


def side_channels(values: DataFrame, plans: DataFrame) -> DataFrame:
    """Failures (doc_id, channel, text_index), one per value and text; values: (doc_id, channel, n)."""
    j = values.select("doc_id", "channel", "n").join(plans.select("doc_id", "texts"), "doc_id").withColumn("hits", needles.places(F.col("n"), F.col("texts")))
    return j.select("doc_id", "channel", F.explode(F.expr("array_distinct(transform(hits, h -> h.needle))")).alias("text_index"))


PIXEL_TOLERANCE, INSET, JPEG_INSET = 8, 2.0, 8.0


def image_pixels(pixels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, area_id, samples, passed): all samples under an area differ by no more than the tolerance in any band.

    pixels: (doc_id, x, y, bands); areas: (doc_id, area_id, box, jpeg). The edges of an area are
    not looked at, more of them in a JPEG image. An area without samples passes.
    """
    inset = F.when(F.col("jpeg"), JPEG_INSET).otherwise(INSET)
    a = areas.select("doc_id", "area_id", (F.col("box.x") + inset).alias("x0"), (F.col("box.y") + inset).alias("y0"),
                     (F.col("box.x") + F.col("box.w") - inset).alias("x1"), (F.col("box.y") + F.col("box.h") - inset).alias("y1"), F.lit(True).alias("closed"))
    j = points_in(pixels, a, ["doc_id"]).select("doc_id", "area_id", F.posexplode("bands").alias("band", "v"))
    spread = j.groupBy("doc_id", "area_id", "band").agg((F.max("v") - F.min("v")).alias("spread"), F.count("*").alias("n"))
    seen = spread.groupBy("doc_id", "area_id").agg(F.max("n").alias("samples"), (F.max("spread") <= PIXEL_TOLERANCE).alias("even"))
    out = areas.select("doc_id", "area_id").join(seen, ["doc_id", "area_id"], "left")
    return out.select("doc_id", "area_id", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("even", F.lit(True)).alias("passed"))


def single_revision(revisions: Column) -> Column:
    return revisions == 1


def checks_from(docs: DataFrame, failures: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, kind, passed, failures) for every document and kind of check."""
    out = None
    for kind, f in failures.items():
        n = f.groupBy("doc_id").agg(F.count("*").alias("failures"))
        one = docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.lit(kind).alias("kind"), F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.lit(0)).alias("failures"))
        out = one if out is None else out.unionByName(one)
    return out


def report(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """(doc_id, outcome, n_checks, n_failed): verified only with a check, and with all passed."""
    c = checks.groupBy("doc_id").agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"))
    j = docs.select("doc_id").join(c, "doc_id", "left").fillna(0, ["n_checks", "n_failed"])
    outcome = F.when((F.col("n_checks") > 0) & (F.col("n_failed") == 0), "verified").otherwise("failed")
    return j.select("doc_id", outcome.alias("outcome"), "n_checks", "n_failed")


def engine_fault(parsed: Column, inspected: Column) -> Column:
    """Which of the two engines could not open an output; null if both could."""
    return F.when(~parsed & ~inspected, "both").when(~parsed, "independentParser").when(~inspected, "inspector")


# The faults of a report, by the engine that failed.
FAULTS = {"both": "bothEnginesFailed", "independentParser": "parserFailed", "inspector": "inspectorFailed"}
# The checks that cannot be made without both engines; the page counts are compared in any case.
DEPENDENT = ["textAbsent", "geometry", "sideChannels", "imagePixels", "singleRevision"]


def outcomes(outputs: DataFrame, failures: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, outcome, fault, n_checks, n_failed, checks) of outputs, by all six checks.

    outputs: (doc_id, parsed, inspected, pages, parsed_pages, inspected_pages, revisions).
    failures: rows with a doc_id for textAbsent, geometry, sideChannels and imagePixels. An output
    that an engine cannot open fails every check that depends on it. checks: array<struct<kind,passed,failures>>.
    """
    every = None
    for kind, f in failures.items():
        one = f.select("doc_id", F.lit(kind).alias("kind"))
        every = one if every is None else every.unionByName(one)
    counted = every.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in failures])
    d = outputs.join(counted, "doc_id", "left").withColumn("engine", engine_fault(F.coalesce("parsed", F.lit(False)), F.coalesce("inspected", F.lit(False))))
    d = d.withColumn("fault", F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair])[F.col("engine")])
    broken = F.col("fault").isNotNull()
    found = {k: F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in failures} | {"singleRevision": F.when(single_revision(F.coalesce("revisions", F.lit(0))), 0).otherwise(1)}
    found = {k: F.when(broken, 1).otherwise(found.get(k, F.lit(0))) for k in DEPENDENT}
    found["pageCount"] = F.when(valid_counts(F.col("pages"), F.col("parsed_pages"), F.col("inspected_pages")), 0).otherwise(1)
    checks = F.array(*[F.struct(F.lit(k).alias("kind"), (n == 0).alias("passed"), n.cast("long").alias("failures")) for k, n in found.items()])
    d = d.select("doc_id", "fault", checks.alias("checks")).withColumn("n_failed", F.expr("cast(size(filter(checks, c -> not c.passed)) as long)"))
    return d.select("doc_id", F.when(F.col("n_failed") == 0, "verified").otherwise("failed").alias("outcome"), "fault", F.size("checks").cast("long").alias("n_checks"), "n_failed", "checks")


def save_decision(outcome: Column) -> Column:
    return F.when(outcome == "verified", "offerSave").otherwise("requireAcknowledgement")
