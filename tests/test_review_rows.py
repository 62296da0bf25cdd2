"""Review in the row of a document: the same as by joins, without a shuffle of findings."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import ingest, review
from veilspan.plans import roster


def rows(df):
    return sorted(map(repr, df.collect()))


def test_areas_and_plans_in_rows_are_those_of_joins(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab  \n\n c") for _ in range(rng.choice([1, 5, 200, 3000]))) for _ in range(40)] + ["\n\n", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [(d, f"k{i}", a, a + rng.randint(0, 60), rng.random() < 0.6) for d, t in enumerate(texts) for i in range(30) for a in [rng.randint(0, len(t))]]
    r = spark.createDataFrame(places, "doc_id long, key string, start int, end int, selected boolean")
    spans = ingest.spans_of(ingest.lines_of(docs))
    own = docs.join(r.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "end", "selected")).alias("redactions")), "doc_id")
    own = own.select("doc_id", "redactions", ingest.lines_in(F.col("text")).alias("lines"))
    assert rows(own.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.*")) == rows(spans.drop("text"))
    every = own.select("doc_id", "redactions", ingest.areas_in(F.col("lines"), F.expr("transform(redactions, r -> struct(r.key as range_id, r.start, r.end))"), ingest.fixed_hull).alias("areas"))
    joined = ingest.areas_for(spans, r.selectExpr("doc_id", "key as range_id", "start as r_start", "end as r_end"), ingest.fixed_glyphs)
    assert rows(every.select("doc_id", F.explode("areas").alias("x")).select("doc_id", "x.*")) == rows(joined) != []
    chosen = F.expr("transform(filter(areas, a -> exists(redactions, r -> r.selected and r.key = a.range_id)), a -> struct(a.page, a.box, 'text' as origin))")
    got = every.select("doc_id", review.plan_of(F.col("redactions"), chosen).alias("p")).where("p is not null").select("doc_id", "p.texts", F.map_entries("p.areas_by_page").alias("a"))
    want = review.plan(r, joined.selectExpr("doc_id", "range_id as key", "page", "box", "'text' as origin")).select("doc_id", "texts", F.map_entries(F.coalesce("areas_by_page", F.create_map().cast("map<int,array<struct<box:struct<x:double,y:double,w:double,h:double>,origin:string>>>"))).alias("a"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["review_intake", "redaction_plan", "redaction_plan_areas"])
def test_review_of_a_corpus_shuffles_the_texts_only(spark, name):
    plan = roster.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # findings, redactions and areas stay in the row of their document


def test_findings_do_not_wait_for_python(spark):
    """Rows with findings wait on disk while a batch is in Python: only texts with marks may go there."""
    docs = spark.createDataFrame([(1, "Caffe\u0301 nero", [(0, 0, 6, "PERSON", "high")]), (2, "ﬁne  Tè", [(0, 0, 5, "PERSON", "low")]), (3, None, []), (4, "Abc", [(0, 1, 3, "X", "medium")])],
                                 "doc_id long, text string, findings array<struct<ord:int,start:int,end:int,category:string,confidence:string>>")
    taken = review.taken_in(docs)
    assert {(r.doc_id, r.key, r.text) for r in review.redactions_of(taken).collect()} == {(1, "caffé", "Caffe\u0301"), (2, "fine", "ﬁne"), (4, "bc", "bc")}
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "Union" in above  # one part of the texts has no Python step
    assert plan.count("ArrowEvalPython") == 1
