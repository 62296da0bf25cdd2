"""Folding, matches, merges, needles, joins by place, outlines and the tagger: against brute force, and on large rows."""

import itertools
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan.functions import folding, needles, normalize
from veilspan.functions.spans import find, is_whole_word, plus, running, whole_word_occurrences
from veilspan.operators import geometry, ner, redact, resolve, review, tagger, verify


# --- folding -----------------------------------------------------------------------------------
def test_folding_is_the_python_pass(spark):
    rng = random.Random(5)
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    odd = [c for c in every if unicodedata.normalize("NFKC", c).lower() != c]
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    pools = [
        "abc  \t\nEé", "aEoN ßΣ̣́̀̈", odd, marks + list("abcdefgh") * 200, every, "   ​­ \r\n" * 3 + "xyﬁ½",
        "кирилЛИЦА 漢字 😀", "กำนหห้อง ", "हिन्दी में ", "مُحَمَّد ",
    ]
    texts = [None, ""] + ["".join(rng.choice(rng.choice(p)) for _ in range(rng.randint(0, 25))) for p in (rng.sample(pools, rng.choice([1, 1, 2])) for _ in range(10_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    native = 0
    for r in normalize.prepare(df).withColumn("hard", folding.is_hard(F.col("text"))).collect():
        if r.text is None:
            assert r.n is None
            continue
        native += not r.hard
        here = list(range(len(r.text) + 1))
        got = (r.n, r.starts, r.ends) if r.starts is not None else (r.n, here[:-1], here[1:])
        assert got == normalize.normalize(r.text)
    assert native > 4_000


# --- folds, matches and merges -----------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running(spark, n):
    v = [random.Random(n).randint(0, 9) for _ in range(n)]
    r = spark.createDataFrame([(v,)], "v array<int>").select(running(F.col("v"), plus).alias("a"), running(F.col("v"), F.greatest).alias("b")).first()
    assert r.a == list(itertools.accumulate(v)) and r.b == list(itertools.accumulate(v, max))


def test_many_matches_in_one_text(spark):
    df = spark.createDataFrame([("ab12 " * 100_000,)], "t string")
    df.select(F.size(find(F.col("t"), "[0-9]+"))).collect()
    began = time.time()
    assert df.select(F.size(find(F.col("t"), "[0-9]+")).alias("n"), find(F.col("t"), "[0-9]+")[99_999]["start"].alias("s")).first()[:] == (100_000, 499_997)
    assert time.time() - began < 10


def slow_merge(cs):
    taken = []
    for c in sorted(cs, key=lambda c: (-["low", "medium", "high"].index(c[3]), c[2] == "ORGANIZATION", c[0] - c[1], c[2] == "CONTEXTUAL_ID", c[0], c[4])):
        if all(c[1] <= k[0] or k[1] <= c[0] for k in taken):
            taken.append(c)
    return sorted(taken)


def test_merge(spark):
    rng = random.Random(7)
    rows = []
    for d in range(60):
        for i in range(rng.choice([0, 1, 2, 30, 400])):
            s = rng.randrange(300)
            rows.append((d, i, s, s + rng.randint(1, 12), rng.choice(["PERSON", "ORGANIZATION", "CONTEXTUAL_ID", "EMAIL"]), rng.choice(["high", "medium", "low"])))
    got = resolve.merge_rows(spark.createDataFrame(rows, "doc_id int, ord int, start int, end int, category string, confidence string"))
    want = [(d, *c) for d in range(60) for c in slow_merge([(s, e, c, k, i) for x, i, s, e, c, k in rows if x == d])]
    assert sorted((r.doc_id, r.start, r.end, r.category, r.confidence, r.ord) for r in got.collect()) == sorted(want)


def test_merge_of_many(spark):
    df = spark.sql("select 1 as doc_id, cast(id as int) as ord, cast(id * 3 as int) as start, cast(id * 3 + 2 + id % 3 as int) as end, 'EMAIL' as category, 'high' as confidence from range(100000)")
    began = time.time()
    assert resolve.merge_rows(df).count() > 50_000
    assert time.time() - began < 20


# --- needles -----------------------------------------------------------------------------------
def wordy(c):
    return unicodedata.category(c)[0] in "LNM"


def slow_places(t, w):
    for i in range(len(t) - len(w) + 1) if w else ():
        if t[i : i + len(w)] == w and not (i and wordy(t[i - 1]) and wordy(w[0])) and not (i + len(w) < len(t) and wordy(w[-1]) and wordy(t[i + len(w)])):
            yield i


def test_one_needle(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice(al) for _ in range(rng.randint(1, 30))), "".join(rng.choice(al) for _ in range(rng.randint(0, 4)))) for al in ("ab .\\E", "aé ") for _ in range(500)]
    df = spark.createDataFrame(rows, "t string, w string").withColumn("o", whole_word_occurrences(F.col("t"), F.col("w")))
    whole = df.withColumn("each", F.expr(f"filter(sequence(0, length(t)), s -> length(w) > 0 and substring(t, s + 1, length(w)) = w and {is_whole_word('t', 's', 's + length(w)')})"))
    for r in whole.collect():
        assert r.o == list(slow_places(r.t, r.w)) == r.each


@pytest.mark.parametrize("n", [3, 1000])
def test_many_needles(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(6):
        t = "".join(rng.choice("ab é.") for _ in range(4000))
        ws = ["", None] + [t[i : i + rng.randint(1, 9)] for i in (rng.randrange(len(t)) for _ in range(n))]
        rows.append((t, ws))
    rows += [(None, ["a"]), ("", ["a"] * 20), ("a b", None), ("a b", [])]
    for r in spark.createDataFrame(rows, "t string, ws array<string>").select("t", "ws", needles.places(F.col("t"), F.col("ws")).alias("p")).collect():
        if r.t is not None and r.ws is not None:
            assert sorted((x.start, x.needle) for x in r.p or []) == sorted((s, i) for i, w in enumerate(r.ws) if w for s in slow_places(r.t, w))


def test_needles_in_a_long_text(spark):
    """A text of four million characters and 1,000 keys: one pass."""
    df = spark.createDataFrame([(1, "".join(f"word{i} " for i in range(400_000)))], "doc_id long, n string")
    keys = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.expr("concat('word', id * 397)").alias("key"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    prepared = df.withColumns({"starts": F.lit(None).cast("array<int>"), "ends": F.lit(None).cast("array<int>")})
    began = time.time()
    assert review.occurrences(keys, prepared).count() == 1000
    assert time.time() - began < 30


def test_scrub_with_many_texts(spark):
    df = spark.createDataFrame([("k1 k2x k3 " * 50, [f"k{i}" for i in range(40)])], "text string, texts array<string>")
    df = df.withColumn("n", F.col("text")).drop("starts")
    r = redact.scrub(df, "text").first()
    assert (r.scrubbed, r.removed) == (" k2x  " * 50, 100)


# --- joins by place ----------------------------------------------------------------------------
def test_overlapping(spark):
    rng = random.Random(9)
    mk = lambda n: [(rng.randrange(3), i, s := rng.randrange(5000), s + rng.choice([0, 1, 7, 300, 4000])) for i in range(n)]
    a, b = mk(150), mk(150)
    j = geometry.overlapping(spark.createDataFrame(a, "doc_id int, x int, a0 int, a1 int"), spark.createDataFrame(b, "doc_id int, y int, b0 int, b1 int"), ["doc_id"], ("a0", "a1"), ("b0", "b1"), 64)
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3]]
    assert sorted((r.x, r.y) for r in j.collect()) == sorted(want)


def test_points_in_boxes(spark):
    rng = random.Random(10)
    pts = [(rng.randrange(2), i, rng.randrange(-500, 1500) / 2, rng.randrange(-500, 1500) / 2) for i in range(300)]
    boxes = [(rng.randrange(2), i, x := rng.randrange(-600, 900) / 2, y := rng.randrange(-600, 900) / 2, x + rng.choice([0, 0.5, 30, 64, 500, 1e6]), y + rng.choice([1, 63, 65, 700]), rng.random() < 0.5) for i in range(80)]
    j = geometry.points_in(spark.createDataFrame(pts, "d int, p int, x double, y double"), spark.createDataFrame(boxes, "d int, b int, x0 double, y0 double, x1 double, y1 double, closed boolean"), ["d"])
    inside = lambda p, b: b[2] < b[4] and b[3] < b[5] and p[2] < b[4] and p[3] < b[5] and ((p[2] >= b[2] and p[3] >= b[3]) if b[6] else (p[2] > b[2] and p[3] > b[3]))
    assert sorted((r.p, r.b) for r in j.collect()) == sorted((p[1], b[1]) for p in pts for b in boxes if p[0] == b[0] and inside(p, b))


def test_a_million_glyphs(spark):
    box = "named_struct('x', double(id % 1000) * 5, 'y', double(id div 1000) * 12, 'w', {w}, 'h', {h})"
    glyphs = spark.range(1_000_000).selectExpr("1 as doc_id", "0 as page", box.format(w="5D", h="12D") + " as box")
    areas = spark.range(10_000).selectExpr("id * 100 + 7 as id").selectExpr("1 as doc_id", "0 as page", box.format(w="2D", h="12D") + " as box")  # no centre lies in these
    began = time.time()
    assert verify.geometry(glyphs, areas).count() == 0
    assert verify.geometry(glyphs, areas.withColumn("box", F.expr("named_struct('x', box.x, 'y', box.y, 'w', 4D, 'h', box.h)"))).count() == 1
    assert time.time() - began < 60


# --- outlines and checks -----------------------------------------------------------------------
def test_outline_order(spark):
    rng = random.Random(11)
    rows = [(d, i, None if i == 0 or rng.random() < 0.1 else rng.randrange(i), rng.randrange(4)) for d in range(4) for i in range(60)] + [(9, 1, 2, 0), (9, 2, 1, 0)]

    def walk(d, limit):
        queue, out = sorted((p, i) for x, i, up, p in rows if x == d and up is None), []
        while queue:
            out += [i for _, i in queue]
            queue = [c for _, i in queue for c in sorted((p, k) for x, k, up, p in rows if x == d and up == i)]
        return [(d, i, n) for n, i in enumerate(out[:limit])]

    df = spark.createDataFrame(rows, "doc_id int, id int, parent int, pos int")
    for limit in (1000, 17):
        got = redact.outline_order(df, limit)
        assert sorted(map(tuple, got.collect())) == sorted(x for d in range(4) for x in walk(d, limit))


def test_faults_fail_what_depends_on_an_engine(spark):
    rows = [(1, True, True, 3, 3, 3, 1), (2, False, True, 3, 3, 3, 1), (3, True, False, 3, None, 3, 1), (4, False, False, 3, 3, 3, 1), (5, True, True, 3, 3, 2, 2), (6, None, True, 3, 3, 3, 1)]
    out = spark.createDataFrame(rows, "doc_id int, parsed boolean, inspected boolean, pages int, parsed_pages int, inspected_pages int, revisions int")
    none = spark.createDataFrame([], "doc_id int")
    got = {r.doc_id: (r.outcome, r.fault, r.n_checks, r.n_failed) for r in verify.outcomes(out, {"textAbsent": none, "geometry": none, "sideChannels": none, "imagePixels": none}).collect()}
    assert got == {
        1: ("verified", None, 6, 0), 2: ("failed", "parserFailed", 6, 5), 3: ("failed", "inspectorFailed", 6, 6), 4: ("failed", "bothEnginesFailed", 6, 5), 5: ("failed", None, 6, 2),
        6: ("failed", "parserFailed", 6, 5),
    }


# --- the tagger --------------------------------------------------------------------------------
def test_viterbi(spark):
    rng = random.Random(12)
    labels = ["B-X", "I-X", "O", "B-Y", "I-Y"]
    steps = {(a, b): rng.uniform(-1, 1) for a in range(-1, 5) for b in range(5)}
    rows = [(i, [[rng.uniform(-2, 2) for _ in labels] for _ in range(rng.randint(0, 5))]) for i in range(40)]

    def total(path, e):
        out, before = 0.0, -1
        for k, row in zip(path, e, strict=True):
            ok = not labels[k].startswith("I-") or (before >= 0 and labels[before] != "O" and labels[before][2:] == labels[k][2:])
            out += row[k] + (steps[before, k] if ok else -1e9)
            before = k
        return out

    for r in spark.createDataFrame(rows, "i int, e array<array<double>>").select("e", tagger.viterbi(F.col("e"), labels, steps).alias("p")).collect():
        assert r.p == list(max(itertools.product(range(5), repeat=len(r.e)), key=lambda p: total(p, r.e)))


def test_tagger_learns(spark):
    names, towns = ["Ada Rossi", "Leo Bianchi", "Eva Greco"], ["Roma", "Bari", "Torino"]
    rows = []
    for i, (a, b) in enumerate(itertools.product(names, towns)):
        t = f"oggi {a} vive a {b}."
        rows.append((i, t, [(5, 5 + len(a), "PERSON"), (5 + len(a) + 8, 5 + len(a) + 8 + len(b), "LOCATION")]))
    df = spark.createDataFrame(rows, "doc_id long, text string, entities array<struct<start:int,end:int,category:string>>")
    m = tagger.train(df, 3)
    held = spark.createDataFrame([(1, "oggi Ugo Ricci vive a Lecce."), (2, "niente da dire"), (3, ""), (4, None)], "doc_id long, text string")
    got = ner.entities(tagger.tag(held, m)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.type) for r in got) == [(1, 5, 14, "PERSON"), (1, 22, 27, "LOCATION")]


# --- long rows ---------------------------------------------------------------------------------
def test_many_tokens_in_one_line(spark):
    """A line of 100,000 words: one pass."""
    df = spark.sql("select array_join(transform(sequence(0, 99999), i -> concat('w', i)), ' ') as text, transform(sequence(0, 99999), i -> concat('w', i)) as tokens")
    df.limit(0).select(ner.token_spans(F.col("text"), F.col("tokens"))).collect()
    began = time.time()
    r = df.select(ner.token_spans(F.col("text"), F.col("tokens")).alias("s")).select(F.size("s").alias("n"), F.col("s")[99_999].alias("last")).first()
    assert (r.n, tuple(r.last)) == (100_000, (688_883, 688_889))
    assert time.time() - began < 10


def test_tokens_without_a_place(spark):
    rows = [(1, "ab cd", ["ab", None, "", "##", "zz", "cd"]), (2, None, ["ab"]), (3, "ab", []), (4, "ab", None), (5, "x" * 25 + "ab", ["ab", "x", "ab"]), (6, "😀é 😀", ["😀é", "▁😀"])]
    got = {r.i: r.s and [x and tuple(x) for x in r.s] for r in spark.createDataFrame(rows, "i int, text string, tokens array<string>").select("i", ner.token_spans(F.col("text"), F.col("tokens")).alias("s")).collect()}
    assert got == {1: [(0, 2), None, None, None, None, (3, 5)], 2: [None], 3: [], 4: None, 5: [None, (0, 1), (25, 27)], 6: [(0, 2), (3, 4)]}


def test_intake_of_a_long_text(spark):
    """A text of 800,000 characters with a finding in every eighth place: the text is not repeated for each."""
    docs = spark.sql("select 1L as doc_id, repeat('abc def ', 100000) as text")
    found = spark.range(100_000).selectExpr("1L as doc_id", "cast(id as int) as ord", "cast(8 * id as int) as start", "cast(8 * id + 4 as int) as end", "'PERSON' as category", "if(id = 77, 'high', 'medium') as confidence")
    review.intake(found.limit(0), docs).collect()
    began = time.time()
    got = [(r.key, r.text, r.confidence, r.start, r.end) for r in review.intake(found, docs).collect()]
    assert got == [("abc", "abc", "high", 0, 3)]
    assert time.time() - began < 30


def test_intake_cuts_and_keys(spark):
    """Cuts of all lengths, over the edges of the cells and of the text, and keys of odd values."""
    rng = random.Random(13)
    text = "".join(rng.choice("aB \n\té😀ﬁ\u0301\u00adΩ  ") for _ in range(1500))
    rows = [(1, i, s := rng.randrange(1500), s + rng.choice([0, 1, 3, 8, 255, 256, 257, 700]), "X", rng.choice(["high", "low"])) for i in range(400)]
    want = {}
    for _, i, s, e, _, level in rows:
        cut = text[s:e]
        if value := cut.strip():
            k = normalize.normalize(value)[0].strip(" ")
            at = s + len(cut) - len(cut.lstrip())
            first = want.get(k, (value, at, at + len(value), level))
            want[k] = (*first[:3], "high" if "high" in (first[3], level) else "low")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = spark.createDataFrame(rows + [(2, 0, 0, 3, "X", "high"), (3, 0, 0, 3, "X", "high"), (4, 0, 0, 3, "X", "high")], "doc_id long, ord int, start int, end int, category string, confidence string")
    assert {r.key: (r.text, r.start, r.end, r.confidence) for r in review.intake(found, docs).collect()} == want


# --- growth of single queries ------------------------------------------------------------------
def test_generated_identifiers_are_dealt_over_the_cores(spark):
    from veilspan.operators import rules
    from veilspan.plans import roster

    plan = roster.QUERIES["identifier_high_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan  # a small table is one row group, which one task reads
    assert rules._CARD_END.index(rules._CARD_DIGITS) < rules._CARD_END.index("sequence(1, length(x.value))")  # worked out once a match, not at each of its places


def test_filters_of_a_long_text(spark):
    """Each candidate's text is looked up near its place, so the time grows with the text, not with its square."""
    n, rng = 600_000, random.Random(3)
    text = "".join(rng.choice("ab \né😀") for _ in range(n))
    spans = [(s, s + rng.choice([1, 4, 5, 9])) for s in range(-5, n, 10)]  # none overlap
    c = [(s, e, "EMAIL", rng.choice(["high", "low"]), "rule", "test") for s, e in spans]
    df = spark.createDataFrame([(1, text, c), (2, "  x", c[:3]), (3, None, c[:3])], "doc_id int, text string, candidates array<struct<start:int,end:int,category:string,confidence:string,method:string,rule:string>>")
    began = time.time()
    got = {r.doc_id: r.f for r in resolve.finalize(df, propagate=False).select("doc_id", F.transform("candidates", lambda x: F.struct(x["start"], x["end"])).alias("f")).collect()}
    assert time.time() - began < 20
    want = [(s, e) for s, e, _, level, _, _ in c if level != "low" and s >= 0 and e <= n and len("".join(text[s:e].split())) >= 3]
    assert [tuple(x) for x in got[1]] == want and got[2] == [] and not got[3]


def test_areas_without_boxes_of_all_glyphs(spark):
    """Boxes are made for the glyphs that a range touches, after the join: they are those of all boxes, cut."""
    from veilspan.operators import ingest
    from veilspan.plans import roster

    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "\n".join("x" * rng.choice([0, 1, 30, 3000]) for _ in range(90))) for i in range(6)], "doc_id int, text string")
    ranges = spark.createDataFrame([(i, k, s := rng.randrange(60_000), s + rng.choice([0, 1, 40, 5000])) for i in range(6) for k in range(40)], "doc_id int, range_id int, r_start int, r_end int")
    spans = ingest.spans_of(ingest.lines_of(docs))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "range_id", "page", "line", "box.*").collect()))
    got = rows(ingest.areas_for(spans, ranges, ingest.fixed_glyphs))
    assert got and got == rows(ingest.areas_for(ingest.fixed_boxes(spans), ranges))
    plan = roster.QUERIES["page_areas"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "char_boxes" not in plan


def test_glyphs_near_areas(spark):
    """The glyphs that are left are all whose centres lie within the areas' hull, with and without the hulls of lines."""
    from veilspan.operators import ingest
    from veilspan.plans import roster

    rng = random.Random(9)
    spans = spark.createDataFrame([(d, p, i, 0, rng.randint(1, 120)) for d in range(3) for p in range(2) for i in range(40)], "doc_id int, page int, line int, start int, end int")
    boxes = [(d, p, (float(rng.randint(0, 500)), float(rng.randint(0, 450)), float(rng.choice([0, 3, 30])), float(rng.choice([5, 25])))) for d in range(3) for p in range(2) for _ in range(3) if (d, p) != (2, 1)]
    areas = spark.createDataFrame(boxes, "doc_id int, page int, box struct<x:double,y:double,w:double,h:double>")
    every = ingest.fixed_boxes(spans).select("doc_id", "page", F.explode("char_boxes").alias("box"))
    rows = lambda df: sorted((r.doc_id, r.page, *r.box) for r in df.collect())
    want = []
    for d, p, x, y, w, h in rows(every):
        own = [b for i, j, b in boxes if (i, j) == (d, p)]
        if own and min(b[0] for b in own) < x + w / 2 < max(b[0] + b[2] for b in own) and min(b[1] for b in own) < y + h / 2 < max(b[1] + b[3] for b in own):
            want.append((d, p, x, y, w, h))
    near = verify.glyphs_near(ingest.fixed_lines(spans), areas, ingest.fixed_glyphs("0", "end - start"))
    assert want and rows(near) == want == rows(verify.glyphs_near(ingest.fixed_boxes(spans), areas))
    assert sorted(verify.geometry(near, areas).collect()) == sorted(verify.geometry(every, areas).collect())
    plan = roster.QUERIES["verify_geometry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "char_boxes" not in plan


def test_cuts_and_forms_without_places(spark):
    """Many ranges are cut out in the JVM, and a form without places is the Python pass's."""
    rng = random.Random(21)
    text = "".join(rng.choice("ab é😀\n") for _ in range(20_000))
    at = sorted(rng.sample(range(20_000), 400))
    ranges = [(a, b) for a, b in zip(at[::2], at[1::2], strict=True)]
    df = spark.createDataFrame([(text, ranges), (text, ranges[:3]), (text, []), (text, None), (None, ranges)], "t string, r array<struct<start:int,end:int>>")
    df = df.withColumn("out", needles.without(F.col("t"), F.col("r")))
    keep = lambda rs: "".join(text[a:b] for a, b in zip([0, *(e for _, e in rs)], [*(s for s, _ in rs), None], strict=True))
    assert [r.out for r in df.collect()] == [keep(ranges), keep(ranges[:3]), text, text, None]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    texts = ["".join(rng.choice(" \t\ń​ aEﬁ") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    forms = normalize.with_form(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert all(r.n == normalize.normalize(r.t)[0] for r in forms)
