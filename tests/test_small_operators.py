"""Operators that no query with an oracle runs: errors, boxes, labels, degradation, sources, checks of a save."""

from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.operators import ner, redact, resolve, review, verify
from veilspan.sources import readers

BOX = "struct<x:double,y:double,w:double,h:double>"


def one(spark, *columns, schema=None, row=None):
    df = spark.range(1) if row is None else spark.createDataFrame([row], schema)
    return tuple(df.select(*columns).first())


def test_ranges_and_candidates(spark):
    lit = F.lit
    assert one(spark, spans.range_error(lit(0), lit(2)), spans.range_error(lit(2), lit(2)), spans.range_error(lit(-1), lit(2))) == (None, "invalidCharRange", "invalidCharRange")
    t = lit("ab  cd")
    got = one(spark, spans.candidate_error(t, lit(0), lit(2)), spans.candidate_error(t, lit(2), lit(4)), spans.candidate_error(t, lit(5), lit(7)), spans.candidate_error(t, lit(3), lit(3)))
    assert got == (None, "blank", "outOfText", "outOfText")
    assert one(spark, spans.overlaps(lit(0), lit(5), lit(5), lit(9)), spans.overlaps(lit(0), lit(5), lit(4), lit(9))) == (False, True)
    assert one(spark, *[spans.rank(lit(c)) for c in ("low", "medium", "high")]) == (0, 1, 2)


def test_boxes(spark):
    row = ((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 5.0, 5.0), (9.0, 9.0, 5.0, 5.0), (1.0, 1.0, 9.4, 2.0))
    schema = f"a {BOX}, b {BOX}, c {BOX}, d {BOX}"
    a, b, c, d = map(F.col, "abcd")
    got = one(spark, spans.boxes_intersect(a, b), spans.boxes_intersect(a, c), spans.box_contains(a, d), spans.box_contains(a, d, 0.5), row=row, schema=schema)
    assert got == (False, True, False, True)
    lit = F.lit
    assert one(spark, spans.box_error(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), spans.box_error(lit(float("nan")), lit(0.0), lit(1.0), lit(1.0)), spans.page_error(lit(-1)), spans.page_error(lit(1.5)),
               spans.area_error(lit(0), lit(0.0), lit(0.0), lit(1.0), lit(1.0))) == ("invalidBoundingBox", "invalidBoundingBox", "invalidPageIndex", "invalidPageIndex", None)
    df = spark.createDataFrame([((0.0, 1.0, 2.0, 2.0),), ((5.0, 0.0, 1.0, 1.0),)], f"b {BOX}")
    assert tuple(df.agg(spans.hull(F.col("b"))).first()[0]) == (0.0, 0.0, 6.0, 3.0)


def test_a_failed_recogniser_degrades_its_document(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com Rossi"), (2, "mail c@d.com Verdi")], "doc_id long, text string")
    cand = "array<struct<start:int,end:int,category:string,confidence:string,method:string,rule:string>>"
    model = spark.createDataFrame([(1, [(13, 18, "PERSON", "high", "ner", "m")], False), (2, None, True)], f"doc_id long, candidates {cand}, failed boolean")
    seen = []

    def assessor(df):
        seen.append(df)
        return df

    got = {r.doc_id: ([c.category for c in r.candidates], r.degraded) for r in resolve.detect(docs, ["email"], model, assessor).collect()}
    assert got == {1: (["EMAIL", "PERSON"], False), 2: (["EMAIL"], True)} and len(seen) == 1
    failed = spark.createDataFrame([(2, 0)], "doc_id long, at int")
    assert {r.doc_id: r.degraded for r in resolve.detect_segmented(docs, 10, ["email"], failed).collect()} == {1: False, 2: True}


def test_bio_labels_are_repaired(spark):
    labels = ["I-A", "I-A", "O", "B-B", "I-A", "I-A"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "doc_id long, idx int, label string")
    assert [r.label for r in ner.repair_bio(df).orderBy("idx").collect()] == ["B-A", "I-A", "O", "B-B", "B-A", "I-A"]


def test_plan_with_areas_and_wire_form(spark):
    r = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "doc_id long, key string, selected boolean")
    areas = spark.createDataFrame([(1, "a", 2, (0.0, 0.0, 1.0, 1.0), "text"), (1, "a", 0, (1.0, 0.0, 1.0, 1.0), "area"), (1, "b", 1, (0.0, 0.0, 1.0, 1.0), "text")],
                                  f"doc_id long, key string, page int, box {BOX}, origin string")
    plans = review.plan(r, areas)
    p = plans.first()
    assert plans.count() == 1 and p.texts == ["a"] and sorted(p.areas_by_page) == [0, 2]
    wire = plans.select(review.to_wire(F.col("areas_by_page")).alias("w"))
    assert [x.key for x in wire.first().w] == [0, 2] and sorted(wire.select(review.from_wire(F.col("w"))).first()[0]) == [0, 2]


def test_events_without_a_document_are_one_document(spark):
    rows = [(None, 0, "addManual", "a"), (None, 1, "addManual", "b"), (None, 2, "undo", ""), (7, 0, "add", "c"), (7, 1, "deselectAll", "")]
    e = spark.createDataFrame(rows, "doc_id long, seq long, op string, key string")
    got = {(r.doc_id, r.position, r.key, r.manual, r.selected) for r in review.replay(e).collect()}
    assert got == {(None, 0, "a", True, True), (7, 0, "c", False, False)}


def test_checks_around_a_save(spark):
    lit = F.lit
    assert one(spark, verify.valid_counts(lit(3), lit(3), lit(3)), verify.valid_counts(lit(3), lit(2), lit(3)), verify.valid_counts(lit(3), lit(None), lit(3))) == (True, False, False)
    assert one(spark, verify.single_revision(lit(1)), verify.single_revision(lit(2))) == (True, False)
    flags = [(True, True), (False, True), (True, False), (False, False)]
    assert one(spark, *[verify.engine_fault(lit(a), lit(b)) for a, b in flags]) == (None, "independentParser", "inspector", "both")
    assert one(spark, verify.save_decision(lit("verified")), verify.save_decision(lit("failed"))) == ("offerSave", "requireAcknowledgement")
    assert one(spark, redact.export_error(lit(0), lit(0)), redact.export_error(lit(2), lit(1)), redact.export_error(lit(2), lit(2))) == ("emptyPlan", "incomplete", None)


def test_outline_entries_beyond_the_limit_stay(spark, monkeypatch):
    monkeypatch.setattr(redact, "OUTLINE_LIMIT", 1)
    values = spark.createDataFrame([(1, "outline", 0, "the end"), (1, "outline", 1, "the end"), (1, "attachments", 0, "the file"), (1, "attachments", 1, "a file")], "doc_id long, channel string, ord int, value string")
    plans = spark.createDataFrame([(1, ["the"])], "doc_id long, texts array<string>")
    got = {(r.channel, r.ord): (r.scrubbed, r.removed) for r in redact.scrub_channels(values, plans).collect()}
    assert got == {("outline", 0): (" end", 1), ("outline", 1): ("the end", 0), ("attachments", 0): (None, 1), ("attachments", 1): ("a file", 0)}


def test_files_and_sentences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.bin").write_bytes(b"y" * 50)
    got = {r.path.rsplit("/", 1)[1]: (r.support, r.content is None) for r in readers.files(spark, str(tmp_path / "in"), 20).collect()}
    assert got == {"a.pdf": (None, False), "b.bin": ("tooLarge", True)}
    (tmp_path / "s.jsonl").write_text('{"text": "Mario", "entities": [{"start": 0, "end": 5, "category": "PERSON"}]}\n')
    assert readers.labelled_sentences(spark, str(tmp_path / "s.jsonl")).first().entities[0].category == "PERSON"
    readers.write_redacted(spark.range(2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
