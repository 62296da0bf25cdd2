"""Long runs of words and labels: patterns that repeat a group must not take a stack frame for each repetition."""

import random

from pyspark.sql import functions as F

from veilspan.operators import names, resolve, rules


def test_text_in_capitals(spark):
    """A run of 20,000 capitalised words ended in a StackOverflowError, which ends the executor."""
    words = [random.Random(4).choice(["ABCD", "Efgh", "LO", "D'Urso"]) for _ in range(20_000)]
    words[7_000:7_001] = ["Mario"]
    text = " ".join(words)
    at = text.index("Mario")
    docs = spark.createDataFrame([(1, text), (2, "scrive Mario Rossi")], "doc_id long, text string")
    got = {(r.doc_id, r.rule, r.start, r.end) for r in resolve.findings(resolve.detect(docs)).collect()}
    assert (2, "first-name-pair", 7, 18) in got
    assert any(d == 1 and rule == "first-name-pair" and s <= at and at + 5 <= e for d, rule, s, e in got)


def test_address_with_a_long_host(spark):
    host = "b." * 30_000 + "example.org"
    docs = spark.createDataFrame([(1, f"mail a@{host} qui")], "doc_id long, text string")
    assert [r[:] for r in resolve.findings(resolve.detect(docs, ["email"])).select("start", "end").collect()] == [(5, 7 + len(host))]


def test_patterns_find_what_they_found(spark):
    """The same matches as the patterns with groups that are given back one by one."""
    rng = random.Random(6)
    email = r"(?<![\p{L}\p{N}._%+-])[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}" + rules.R
    run = rf"{names.CAPITALISED}(?:[ \t]+{names.CAPITALISED})+"
    parts = ["a", "b1", ".", ".", ".com", ".it", "@", "@", "-", "..", "é", " ", " x@c", "_"]
    for new, old, pieces in ((rules.EMAIL, email, parts), (names.CAPITALISED_RUN, run, list("ABab' \t-.È"))):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 24))) for _ in range(30_000)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        both = df.select("t", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in (("new", new), ("old", old))))
        assert both.where("new <> old").count() == 0 and both.where("size(old) > 0").count() > 1_000
