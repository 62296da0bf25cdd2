"""Resolution of candidates, one row per document: filters, greedy merge, name propagation, segments.

Everything works on the candidates array of a row, so that no shuffle is needed: a document's
candidates never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.functions import normalize
from veilspan.functions.spans import CANDIDATES, cuts, rank, running

MIN_CHARS = 3
SEGMENT_CHARS = 12_000


def _order(x: Column, i: Column) -> Column:
    """The priority of a candidate, at place i of its array, as a struct that sorts ascending."""
    return F.struct(
        (-rank(x["confidence"])).alias("p1"), (x["category"] == "ORGANIZATION").alias("p2"), (x["start"] - x["end"]).alias("p3"),
        (x["category"] == "CONTEXTUAL_ID").alias("p4"), x["start"].alias("p5"), i.alias("p6"),
    )


def merged(candidates: Column) -> Column:
    """The candidates that survive, ordered by start.

    Candidates are taken by priority (confidence, not an organisation, length, not a contextual id,
    start, place in the array) unless they overlap one already taken; touching is no overlap. Only
    candidates of one island (a range that overlaps link) can be in each other's way.
    """
    placed = F.array_sort(F.transform(candidates, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"), _order(x, i).alias("o"), x.alias("c"))))

    def islands_of(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
        cut = lambda h: F.transform(h, lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - i))
        return F.transform(F.array(heads), cut)[0]

    def greedy(island: Column) -> Column:
        free = lambda a, x: ~F.exists(a, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        queue = F.transform(F.array_sort(F.transform(island, lambda x: F.struct(x["o"].alias("o"), x["c"].alias("c")))), lambda x: x["c"])
        taken = F.aggregate(queue, F.slice(candidates, 1, 0), lambda a, x: F.when(free(a, x), F.array_append(a, x)).otherwise(a))
        by_start = F.array_sort(taken, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
        return F.when(F.size(island) == 1, F.transform(island, lambda x: x["c"])).otherwise(by_start)

    ends = lambda s: F.array(running(F.transform(s, lambda x: x["end"]), F.greatest))
    several = F.flatten(F.transform(F.transform(F.array(placed), lambda s: F.transform(ends(s), lambda r: islands_of(s, r))[0])[0], greedy))
    return F.when(F.size(candidates) > 1, several).otherwise(candidates)


def filtered(candidates: Column, text: Column) -> Column:
    """Candidates that are not low, inside the text, and have enough characters that are not white space."""

    def inside(size: Column) -> Column:
        return F.filter(candidates, lambda x: (x["confidence"] != "low") & (x["start"] >= 0) & (x["end"] <= size))

    def full(c: Column) -> Column:
        enough = lambda pieces: F.filter(c, lambda x, i: F.length(F.regexp_replace(F.get(pieces, i), r"\s+", "")) >= MIN_CHARS)
        return F.transform(F.array(cuts(text, c)), enough)[0]

    return F.transform(F.transform(F.array(F.length(text)), inside), full)[0]


def finalize(df: DataFrame, column: str = "candidates", propagate: bool = True) -> DataFrame:
    """df with the final candidates in the same column."""
    df = df.withColumn("_f", filtered(F.col(column), F.col("text"))).withColumn(column, merged(F.col("_f"))).drop("_f")
    if not propagate:
        return df
    from veilspan.operators import names

    return names.propagate(df, column)


def detect(docs: DataFrame, rule_names: list[str] | None = None, model: DataFrame | None = None, assessor=None, first_names: list[str] | DataFrame | None = None) -> DataFrame:
    """doc_id, text, candidates (final) and degraded, from documents.

    model: optional rows (doc_id, candidates, failed) of a recogniser; a document whose recogniser
    failed keeps its rule findings and is degraded. assessor: optional DataFrame to DataFrame step.
    first_names: a list or a one-column table instead of the default sample.
    """
    from veilspan.operators import rules

    d = rules.detect(normalize.prepare(docs), rule_names, first_names=first_names)
    d = d.select("doc_id", "text", "candidates")
    if model is not None:
        extra = model.select("doc_id", F.col("candidates").alias("_model"), F.col("failed").alias("_failed"))
        d = d.join(extra, "doc_id", "left")
        d = d.withColumn("candidates", F.when(F.coalesce("_failed", F.lit(False)) | F.col("_model").isNull(), F.col("candidates")).otherwise(F.concat("candidates", "_model")))
        d = d.select("doc_id", "text", "candidates", F.coalesce("_failed", F.lit(False)).alias("degraded"))
    else:
        d = d.withColumn("degraded", F.lit(False))
    d = finalize(d)
    return assessor(d) if assessor is not None else d


def findings(detected: DataFrame) -> DataFrame:
    """One row per final candidate."""
    # an outer explode: from an inner one a filter on the size is pushed to the scan, with all rules in it once more
    c = detected.select("doc_id", F.posexplode_outer("candidates").alias("ord", "c")).where("c is not null")
    return c.select("doc_id", "ord", "c.start", "c.end", "c.category", "c.confidence", "c.method", "c.rule")


def detect_segmented(docs: DataFrame, segment_chars: int = SEGMENT_CHARS, rule_names: list[str] | None = None, failed: DataFrame | None = None) -> DataFrame:
    """doc_id, text, candidates, degraded: segments are resolved on their own, then together once more.

    failed: optional rows (doc_id, at) of segments whose recogniser failed; their documents are degraded.
    """
    from veilspan.operators.ner import chunks

    pieces = docs.select("doc_id", "text", F.explode(chunks(F.col("text"), segment_chars)).alias("k"))
    pieces = pieces.select(F.struct("doc_id", F.col("k.start").alias("at")).alias("doc_id"), F.col("k.text").alias("text"))
    own = detect(pieces, rule_names)
    shifted = own.select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.at").alias("at"),
        F.expr("transform(candidates, c -> struct(c.start + doc_id.at as start, c.end + doc_id.at as end, c.category, c.confidence, c.method, c.rule))").alias("c"),
    )
    together = shifted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("s"))
    together = together.select("doc_id", F.expr(f"cast(flatten(transform(s, x -> x.c)) as {CANDIDATES})").alias("candidates"))
    d = docs.select("doc_id", "text").join(together, "doc_id", "left")
    d = finalize(d.withColumn("candidates", F.coalesce("candidates", F.expr(f"cast(array() as {CANDIDATES})"))))
    if failed is None:
        return d.withColumn("degraded", F.lit(False))
    bad = failed.select("doc_id").distinct().withColumn("_bad", F.lit(True))
    return d.join(bad, "doc_id", "left").withColumn("degraded", F.coalesce("_bad", F.lit(False))).drop("_bad")


def merge_rows(candidates: DataFrame) -> DataFrame:
    """The greedy merge for candidates kept as rows (doc_id, ord, start, end, category, confidence)."""
    one = candidates.groupBy("doc_id").agg(F.expr("transform(sort_array(collect_list(struct(ord, struct(start, end, category, confidence, ord) as c))), x -> x.c)").alias("c"))
    return one.select("doc_id", F.explode(merged(F.col("c"))).alias("c")).select("doc_id", "c.*")


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = False) -> DataFrame:
    """df with `island`: ranges of one key that overlap (or touch) through others share a number."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    df = df.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    return df.withColumn("island", F.sum("_new").over(order)).drop("_new")
