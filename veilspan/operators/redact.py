"""Redaction of texts and side-channel values, and the checks of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.functions import needles


def scrub(df: DataFrame, value: str = "value", n: str = "n", texts: str = "texts") -> DataFrame:
    """df with scrubbed (the value without all whole-word matches of texts in n) and removed (how many disjoint ranges went).

    n is the normalised value with identical offsets, or with starts and ends of `prepare`.
    """
    d = df.withColumn("_hits", needles.places(F.col(n), F.col(texts))).withColumn("_r", needles.united(F.col("_hits")))
    if "starts" in df.columns:
        d = d.withColumn("_r", F.expr("if(starts is null, _r, transform(_r, x -> struct(starts[x.start] as start, ends[x.end - 1] as end)))"))
    d = d.withColumn("scrubbed", needles.without(F.col(value), F.col("_r")))
    return d.withColumn("removed", F.size("_r")).drop("_r", "_hits")


def contains_any(n: Column, texts: Column) -> Column:
    """A redacted text stands in the normalised value as whole words."""
    return F.size(needles.places(n, texts)) > 0


def attachment_decision(name: Column, content: Column, texts: Column) -> Column:
    return F.when(contains_any(name, texts) | contains_any(content, texts), "remove").otherwise("keep")


# The side channels of a document, and how many outline entries are looked at.
CHANNELS = ["infoDictionary", "xmp", "outline", "annotations", "formFields", "attachments"]
OUTLINE_LIMIT = 10_000


def outline_order(entries: DataFrame, limit: int = OUTLINE_LIMIT) -> DataFrame:
    """(doc_id, id, ord) of the first `limit` outline entries of each document in breadth-first order.

    entries: (doc_id, id, parent, pos), parent null at the top; siblings are ordered by pos and id.
    Each round joins the entries below those of the last one; what lies beyond the limit, or below
    no top entry, has no number. (A recursive query would stop at a fixed number of rows in all.)
    """
    from veilspan.sources.shared import cut

    level, before, out = entries.where("parent is null").select("doc_id", "id", F.lit(0).alias("up"), "pos"), None, None
    while True:
        w = Window.partitionBy("doc_id").orderBy("up", "pos", "id")
        ranked = level.withColumn("r", F.row_number().over(w) - 1)
        if before is not None:
            ranked = ranked.join(before, "doc_id").withColumn("r", F.col("r") + F.col("n"))
        ranked = cut(ranked.where(F.col("r") < limit).select("doc_id", "id", F.col("r").cast("int").alias("ord")), "outline")
        if ranked.isEmpty():
            return ranked if out is None else out
        out = ranked if out is None else out.unionByName(ranked)
        before = ranked.groupBy("doc_id").agg((F.max("ord") + 1).alias("n"))
        level = entries.join(ranked.select("doc_id", F.col("id").alias("parent"), F.col("ord").alias("up")), ["doc_id", "parent"]).select("doc_id", "id", "up", "pos")


def scrub_channels(values: DataFrame, plans: DataFrame) -> DataFrame:
    """(doc_id, channel, ord, scrubbed, removed) of side-channel values (doc_id, channel, ord, value) by plans (doc_id, texts).

    Texts are cut out of values; an attachment goes as a whole (null). Outline entries are in
    breadth-first order, and those beyond OUTLINE_LIMIT are left alone.
    """
    from veilspan.functions import normalize

    v = values.join(plans.select("doc_id", "texts"), "doc_id")  # before the texts have offsets, which are larger than they
    v = v.select(F.struct("doc_id", "channel", "ord", "texts").alias("doc_id"), F.col("value").alias("text"))
    v = normalize.prepare(v).select("doc_id.*", F.col("text").alias("value"), "n", "starts", "ends")
    d = scrub(v)
    whole, far = F.col("channel") == "attachments", (F.col("channel") == "outline") & (F.col("ord") >= OUTLINE_LIMIT)
    gone = whole & (F.col("removed") > 0)
    kept = F.when(far, F.col("value")).when(whole & ~gone, F.col("value")).when(~gone, F.col("scrubbed"))
    return d.select("doc_id", "channel", "ord", kept.alias("scrubbed"), F.when(far, 0).when(gone, 1).otherwise(F.col("removed")).alias("removed"))


def channel_counts(scrubbed: DataFrame) -> DataFrame:
    """(doc_id, channel, removed) without zero counts."""
    return scrubbed.groupBy("doc_id", "channel").agg(F.sum("removed").alias("removed")).where("removed > 0")


def line_art_mode(origin: Column) -> Column:
    """Drawings go when covered by a text's area, and when touched by a drawn area."""
    return F.when(origin == "text", "removeIfCovered").when(origin == "area", "removeIfTouched")


def export_error(planned: Column, applied: Column) -> Column:
    return F.when(planned == 0, "emptyPlan").when(planned != applied, "incomplete")
