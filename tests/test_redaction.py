import pytest
from pyspark.sql import functions as F

from veilspan.functions import normalize
from veilspan.operators import evaluate, ingest, redact, verify
from veilspan.streaming import live


def _scrub(spark, value, texts):
    df = normalize.prepare(spark.createDataFrame([(1, value)], "doc_id long, text string")).withColumn("texts", F.array(*map(F.lit, texts)))
    r = redact.scrub(df, "text").first()
    return r.scrubbed, r.removed


def test_scrub_merges_touching_ranges(spark):
    assert _scrub(spark, "Ada Poe, Rome", ["ada poe", "poe", "rome"]) == (", ", 2)
    assert _scrub(spark, "Fenwicks stay", ["fenwick"]) == ("Fenwicks stay", 0)
    assert _scrub(spark, "aa aa aa", ["aa aa"]) == ("", 1)  # overlapping occurrences count


def test_geometry_is_strict(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    glyphs = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, (0.0, 0.0, 10.0, 10.0))], f"doc_id long, page int, box {box}")
    areas = spark.createDataFrame([(1, 0, (5.0, 0.0, 10.0, 10.0)), (1, 1, (4.0, 0.0, 10.0, 10.0))], f"doc_id long, page int, box {box}")
    assert [r.page for r in verify.geometry(glyphs, areas).collect()] == [1]


def test_no_checks_is_a_failure(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    none = spark.createDataFrame([], "doc_id long, kind string, passed boolean, failures long")
    assert verify.report(docs, none).first().outcome == "failed"


def test_lines_and_text(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd")], "doc_id long, text string")
    spans = {(r.line, r.start, r.end) for r in ingest.spans_of(ingest.lines_of(docs)).collect()}
    assert spans == {(0, 0, 2), (2, 4, 6)}
    assert ingest.joined_text(ingest.lines_of(docs, 2)).first().text == "ab\n\fcd"


def test_marked_texts(spark):
    r = evaluate.parse_marked(spark.createDataFrame([(1, "a ⟦bc⟧ d⟦e⟧")], "doc_id long, marked string")).first()
    assert r.text == "a bc de" and [(g.start, g.end) for g in r.gold] == [(2, 4), (6, 7)]


@pytest.mark.parametrize(("recall", "precision", "want"), [(0.99, 0.99, "target"), (0.9, 0.99, "minimum"), (0.99, 0.9, "fail")])
def test_tiers(spark, recall, precision, want):
    assert spark.range(1).select(evaluate.tier(F.lit(recall), F.lit(precision)).alias("t")).first().t == want


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    live.start(docs, str(tmp_path / "out"), str(tmp_path / "cp"), ["email"]).awaitTermination(120)
    assert [r.category for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["EMAIL"]
