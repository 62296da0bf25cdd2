"""Scores of findings against labelled spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import plus, running
from veilspan.operators.geometry import overlapping

PRECISION_TARGET, RECALL_TARGET, RECALL_MINIMUM = 0.95, 0.95, 0.85


def covered(gold: DataFrame, proposed: DataFrame, texts: DataFrame) -> DataFrame:
    """gold (doc_id, gold_id, start, end, ...) with found: every character that is not white space lies in a proposal."""
    g = gold.select("doc_id", "gold_id", F.col("start").alias("g0"), F.col("end").alias("g1"))
    p = proposed.select("doc_id", F.col("start").alias("p0"), F.col("end").alias("p1")).distinct()
    within = overlapping(g, p, ["doc_id"], ("g0", "g1"), ("p0", "p1")).groupBy("doc_id", "gold_id").agg(F.array_sort(F.collect_list(F.struct("p0", "p1"))).alias("ps"))
    j = g.join(within, ["doc_id", "gold_id"], "left").join(texts.select("doc_id", "text"), "doc_id").withColumn("ps", F.coalesce("ps", F.expr("cast(array() as array<struct<p0:int,p1:int>>)")))
    # what lies between the proposals, each after the furthest end so far, is white space
    j = j.withColumn("reach", running(F.expr("transform(ps, p -> p.p1)"), F.greatest))
    gaps = r"""forall(concat(transform(ps, (p, i) -> struct(if(i = 0, g0, greatest(g0, reach[i - 1])) as a, p.p0 as b)), array(struct(greatest(g0, coalesce(try_element_at(reach, -1), g0)) as a, g1 as b))),
        x -> x.b <= x.a or substring(text, x.a + 1, x.b - x.a) rlike r'^\s*$')"""
    missed = j.where(~F.expr(gaps)).select("doc_id", "gold_id").distinct().withColumn("_missed", F.lit(True))
    return gold.join(missed, ["doc_id", "gold_id"], "left").withColumn("found", F.col("_missed").isNull()).drop("_missed")


def recall(found: DataFrame, keys: list[str]) -> DataFrame:
    """found, total and recall by the keys, with their rollup."""
    r = found.rollup(*keys).agg(F.count_if("found").alias("found"), F.count("*").alias("total"))
    return r.withColumn("recall", recall_rate(F.col("found"), F.col("total")))


def recall_rate(found: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(found / total)


def precision(proposed: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, shown, shown_correct, preselected, preselected_correct): correct means overlapping a gold span."""
    p = proposed.select("doc_id", F.col("start").alias("p0"), F.col("end").alias("p1"), "confidence").groupBy("doc_id", "p0", "p1", "confidence").agg(F.count("*").alias("n"))
    hit = overlapping(p, gold.select("doc_id", "start", "end"), ["doc_id"], ("p0", "p1"), ("start", "end")).select("doc_id", "p0", "p1", "confidence").distinct().withColumn("ok", F.lit(True))
    j = p.join(hit, ["doc_id", "p0", "p1", "confidence"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    high = F.col("confidence") == "high"
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return j.groupBy("doc_id").agg(
        F.sum("n").alias("shown"), total(F.col("ok")).alias("shown_correct"), total(high).alias("preselected"), total(high & F.col("ok")).alias("preselected_correct")
    )


def expand_occurrences(proposed: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, start, end, confidence): every whole-word place of each proposed text in any case, with its highest confidence."""
    p = proposed.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.expr("lower(substring(text, start + 1, end - start))").alias("value"), "confidence")
    level = F.max(F.expr("case confidence when 'high' then 2 when 'medium' then 1 else 0 end"))
    p = p.where("value <> ''").groupBy("doc_id", "value").agg(level.alias("level"), F.any_value("text").alias("text"))
    whole = r"concat(r'(?iu)(?<![\p{L}\p{N}])\Q', value, r'\E(?![\p{L}\p{N}])')"
    ends = running(F.expr(f"transform(split(text, {whole}, -1), g -> length(g) + length(value))"), plus)
    o = p.withColumn("ends", ends).select("doc_id", "value", "level", F.explode(F.expr("transform(slice(ends, 1, size(ends) - 1), e -> e - length(value))")).alias("start"))
    return o.selectExpr("doc_id", "start", "cast(start + length(value) as int) as end", "element_at(array('low', 'medium', 'high'), level + 1) as confidence").distinct()


def lcg(state: str) -> str:
    """SQL: the next state of a linear congruential generator modulo 2^31."""
    return f"(({state}) * 1103515245 + 12345) % 2147483648"


def fill_templates(keys: DataFrame, template: list[str], slots: list[list[str]]) -> DataFrame:
    """(doc_id, text, entities) of keys (doc_id): a template with one slot between any two of its pieces, filled from lists by the generator seeded with the key.

    entities: array<struct<start,end,slot>>, where each filling lies in the text.
    """
    draws, state = [], "doc_id"
    for words in slots:
        state = lcg(state)
        values = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
        draws.append(f"array({values})[cast(({state}) div 65536 % {len(words)} as int)]")
    d = keys.select("doc_id", F.expr(f"array({', '.join(draws)})").alias("f"), F.array(*map(F.lit, template)).alias("t"))
    text = "concat_ws('', transform(t, (x, i) -> concat(x, coalesce(get(f, i), ''))))"
    spans = """aggregate(sequence(0, size(f) - 1), struct(0 as at, cast(array() as array<struct<start:int,end:int,slot:int>>) as out), (a, i) -> struct(
        a.at + length(t[i]) + length(f[i]) as at, array_append(a.out, struct(a.at + length(t[i]) as start, a.at + length(t[i]) + length(f[i]) as end, i as slot)) as out)).out"""
    return d.select("doc_id", F.expr(text).alias("text"), F.expr(spans).alias("entities"))


def high_rate(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, high, total, rate) of generated values (doc_id, kind, category) that are found high (doc_id, category, confidence)."""
    hit = found.where("confidence = 'high'").select("doc_id", "category").distinct().withColumn("hit", F.lit(1))
    j = expected.join(hit, ["doc_id", "category"], "left").groupBy("kind").agg(F.count("hit").alias("high"), F.count("*").alias("total"))
    return j.withColumn("rate", recall_rate(F.col("high"), F.col("total")))


def tier(person_recall: Column, preselected_precision: Column) -> Column:
    return F.when((preselected_precision < PRECISION_TARGET) | (person_recall < RECALL_MINIMUM), "fail").when(person_recall >= RECALL_TARGET, "target").otherwise("minimum")


def parse_marked(marked: DataFrame) -> DataFrame:
    """(doc_id, text, gold) of texts with ⟦marked⟧ spans (doc_id, marked)."""
    parts = F.split("marked", "[⟦⟧]", -1)
    fold = """aggregate(transform(p, (x, i) -> struct(x as x, i % 2 = 1 as inside)), struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as out),
        (a, x) -> struct(a.at + length(x.x) as at, if(x.inside, array_append(a.out, struct(a.at as start, a.at + length(x.x) as end)), a.out) as out)).out"""
    return marked.withColumn("p", parts).select("doc_id", F.array_join("p", "").alias("text"), F.expr(fold).alias("gold"))
