import pytest
from pyspark.sql import functions as F

from veilspan.functions import checksums, normalize
from veilspan.operators import names, ner, resolve, review

CASES = [
    ("Write to a.b+c@mail.example.org now", [("a.b+c@mail.example.org", "EMAIL", "high")]),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("GB82 WEST 1234 5698 7654 32", "IBAN", "high")]),
    ("ref GB82WEST12345698765433", [("GB82WEST12345698765433", "IBAN", "medium")]),
    ("5500-0000-0000-0004", [("5500-0000-0000-0004", "PAYMENT_CARD", "high")]),
    ("5500-0000-0000-0005", [("5500-0000-0000-0005", "CONTEXTUAL_ID", "high")]),
    ("card 5500000000000005", [("5500000000000005", "PAYMENT_CARD", "high")]),
    ("cell 347 555 0199", [("347 555 0199", "PHONE", "high")]),
    ("347 555 0199", []),
    ("lot 2024-118822", [("2024-118822", "CONTEXTUAL_ID", "high")]),
    ("12/03/2024", []),
    ("order no. 77-ABC9", [("77-ABC9", "CONTEXTUAL_ID", "high")]),
    ("see report.pdf or shop.example.com/a?b.", [("shop.example.com/a?b", "URL", "high")]),
    ("fine.It follows", []),
    ("Ms Fenwick met Fenwicks", [("Fenwick", "PERSON", "high")]),
    ("codice fiscale RSSMRA85T10A562S", [("RSSMRA85T10A562S", "IT_TAX_CODE", "high")]),
    ("le rss RSSMRA 85T10 A562S", [("RSSMRA 85T10 A562S", "IT_TAX_CODE", "high")]),
    ("targa MI 123456 DEL", [("MI 123456", "VEHICLE_PLATE", "high")]),
    ("via Roma 12, 20100 Milano (MI)", [("via Roma 12, 20100 Milano (MI)", "LOCATION", "high")]),
    ("inviato via Email 12", []),
    ("Initech Ltd. and ACME LLC", [("Initech Ltd.", "ORGANIZATION", "high"), ("ACME LLC", "ORGANIZATION", "high")]),
    ("Comune di residenza", []),
    ("Contraente: ALFA SRL", [("ALFA SRL", "ORGANIZATION", "high")]),
    ("Rossi Mario, poi ROSSI", [("Rossi Mario", "PERSON", "high"), ("ROSSI", "PERSON", "high")]),
    ("ﬁrst  line a@b.com", [("a@b.com", "EMAIL", "high")]),
    ("", []),
    (None, []),
]


def test_golden_findings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r for r in resolve.detect(df).collect()}
    for i, (text, want) in enumerate(CASES):
        found = [(text[c.start : c.end], c.category, c.confidence) for c in got[i].candidates or []]
        assert found == want, text


def test_normalize_maps_to_clusters():
    n, starts, ends = normalize.normalize("ﬁ  Á​b")
    assert n == "fi áb"
    assert starts == [0, 0, 1, 3, 6] and ends == [1, 1, 2, 5, 7]


def test_merge_priorities(spark):
    rows = [
        (1, 0, 0, 10, "CONTEXTUAL_ID", "high"), (1, 1, 0, 10, "IBAN", "high"), (2, 0, 0, 20, "ORGANIZATION", "high"), (2, 1, 12, 20, "PERSON", "high"),
        (3, 0, 0, 5, "EMAIL", "high"), (3, 1, 5, 9, "URL", "medium"), (4, 0, 0, 9, "URL", "medium"), (4, 1, 3, 5, "EMAIL", "high"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, ord int, start int, end int, category string, confidence string")
    got = {(r.doc_id, r.category) for r in resolve.merge_rows(df).collect()}
    assert got == {(1, "IBAN"), (2, "PERSON"), (3, "EMAIL"), (3, "URL"), (4, "EMAIL")}


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [("iban", "GB82WEST12345698765432", True), ("iban", "GB82WEST12345698765433", False), ("luhn", "4111111111111111", True), ("luhn", "", False),
     ("vat", "01234567897", True), ("vat", "01234567890", False), ("tax_code", "RSSMRA85T10A562S", True), ("tax_code", "RSSMRA85T10A562T", False)],
)
def test_checksums(spark, expr, value, want):
    got = spark.createDataFrame([(value,)], "s string").selectExpr(f"{getattr(checksums, expr)('s')} as ok").first().ok
    assert got is want


def test_chunks_cover_the_text():
    text = "\n".join("x" * (37 * i % 300) for i in range(60)) + "\n" + "y " * 700 + "z" * 1300
    out = list(ner.chunk_ranges(text, 500))
    assert out[0][0] == 0 and out[-1][1] == len(text) and all(0 < b - a <= 501 for a, b in out)
    assert all(c <= b and c > a for (a, b), (c, _) in zip(out, out[1:], strict=False))
    assert list(ner.chunk_ranges("ab\ncd\nefghij", 6)) == [(0, 6), (6, 12)] and list(ner.chunk_ranges("", 6)) == []
    assert list(ner.chunk_ranges("ab\ncd\nefghij", 7)) == [(0, 6), (3, 6), (6, 12)]  # a line below half the limit is read again


def test_token_alignment(spark):
    tokens = ["Mar", "##io", "[UNK]", "Rossi", ","]
    df = spark.createDataFrame([(1, 0, "Mario Rossi,", tokens)], "doc_id long, chunk int, text string, tokens array<string>")
    r = df.select(ner.token_spans(F.col("text"), F.col("tokens")).alias("s"), ner.word_starts(F.col("tokens")).alias("f")).first()
    assert [x and tuple(x) for x in r.s] == [(0, 3), (3, 5), None, (6, 11), (11, 12)] and r.f == [True, False, True, True, True]
    words = [(w.first_token, w.start, w.end) for w in ner.aligned(df).orderBy("word").collect()]
    assert words == [(0, 0, 5), (2, None, None), (3, 6, 11), (4, 11, 12)]


def test_model_casing(spark):
    df = spark.createDataFrame([("ROSSI e SpA, IL Dott. ÈVA A",)], "t string")
    assert df.select(ner.model_casing(F.col("t")).alias("t")).first().t == "Rossi e SpA, Il Dott. Èva A"


def test_equal_findings_of_overlapping_chunks(spark):
    e = spark.createDataFrame([(1, 1, 5, 9, "PERSON", 0.7), (1, 0, 5, 9, "PERSON", 0.9), (1, 0, 5, 9, "EMAIL", 0.4)], "doc_id long, chunk int, start int, end int, category string, score double")
    assert {(r.category, r.score) for r in ner.dedupe(e).collect()} == {("PERSON", 0.9), ("EMAIL", 0.4)}


def test_first_names_from_a_table(spark):
    df = spark.createDataFrame([(1, "scrive Zelda Bianchi oggi")], "doc_id long, text string")
    table = spark.createDataFrame([("Zelda",), (None,)], "name string")
    assert resolve.detect(df, ["first-name-pair"]).first().candidates == []
    assert [(c.start, c.end) for c in resolve.detect(df, ["first-name-pair"], first_names=table).first().candidates] == [(7, 20)]


def test_policies():
    assert names.grade_person("avv. Ferrari ok", (5, 12), 0.5, 1) == (5, 12, "high")
    assert names.grade_person("poi ROSSI MARIO", (10, 15), 0.95, 1) == (4, 15, "high")
    assert names.grade_organization("la Spettabile Acme vende", (3, 18), 0.9) == (14, 18, "medium")
    assert names.grade_other("Roma", (0, 4), 0.999, "LOCATION") is None


def test_commands_and_history():
    run = review.run_commands
    assert run([("add", "a"), ("addManual", "b"), ("delete", "b"), ("undo", "")]) == [("a", False, True), ("b", True, True)]
    assert run([("add", "a"), ("deselect", "a"), ("undo", ""), ("redo", "")]) == [("a", False, False)]
    assert run([("add", "a"), ("delete", "a")]) == [("a", False, True)]  # only manual items can be deleted


def test_join_adjacent(spark):
    texts = spark.createDataFrame([(1, "Mario Rossi x Bo")], "doc_id long, text string")
    e = spark.createDataFrame([(1, 0, 5, "PERSON", 0.9), (1, 6, 11, "PERSON", 0.8), (1, 14, 16, "PERSON", 0.7)], "doc_id long, start int, end int, category string, score double")
    got = sorted((r.start, r.end, r.score) for r in ner.join_adjacent(e, texts).collect())
    assert got == [(0, 11, 0.8), (14, 16, 0.7)]
