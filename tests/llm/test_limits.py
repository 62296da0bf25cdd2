"""Long texts in the secret scan, and vectors of any magnitude in the neighbour search."""

import math
import random
import string
import time

from veilspan.llm import ann, secrets

ALPHABET = string.ascii_letters + string.digits


def table(spark):
    """Transitions learnt from a few texts, so that random strings stand out."""
    rng = random.Random(1)
    rows = [(i, "the quick brown fox of documents and sentences password: " + "".join(rng.choice(ALPHABET) for _ in range(30))) for i in range(300)]
    return secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))


def slow_spans(text, scores, spans):
    """The tokens that a plain loop adds to base spans."""
    import re

    out = []
    for m in re.finditer(secrets.TOKEN, text):
        t = m[0]
        if any(s < m.end() and m.start() < e for s, e in spans):
            continue
        total = sum(scores[(ord(a) - 33) * 94 + ord(b) - 33] for a, b in zip(t, t[1:]))
        if round(total / (len(t) - 1), 9) > secrets.THRESHOLD:
            out.append((m.start(), m.end()))
    return out


def test_many_and_long_tokens(spark):
    rng = random.Random(2)
    scores = [round(x, 6) for x in table(spark)]
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = ["", None, word(2_000_000), " ".join(word(24) for _ in range(60_000)), "password=" + word(30) + " " + word(30) + " AKIA" + "A" * 20 + " " + "ab12" * 9 + " secret: " + word(8)]
    texts += [" ".join(rng.choice([word(25), "password:" + word(9), "plainwordsandmore" * 2, "AKIA" + "Z" * 20, "deadbeef" * 4, "x"]) for _ in range(150)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    rows = secrets.scan(df, scores).select("doc_id", "text", "secret_base", "secret_spans").collect()
    assert time.time() - began < 60
    for r in rows:
        base = [(s.start, s.end) for s in r.secret_base]
        got = [(s.start, s.end) for s in r.secret_spans]
        assert got == sorted(got) or {s for s, _ in got} <= {s for s, _ in base + got}
        assert sorted(got) == sorted(base + slow_spans(r.text or "", scores, base))


def test_masks_of_many_spans(spark):
    """More spans than FEW_SPANS are cut out of the array of characters, with the same result."""
    rng = random.Random(3)
    scores = table(spark)
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = [" é ".join("password=" + word(20) + rng.choice(["", "", "AKIA" + "B" * 20]) for _ in range(n)) for n in (1, 10, secrets.FEW_SPANS + 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.secret_spans] for r in secrets.scan(df, scores).select("doc_id", "secret_spans").collect()}
    for r in secrets.redact(df, scores).collect():
        at, out = 0, ""
        for s, e in spans[r.doc_id]:
            if s >= at:
                out += texts[r.doc_id][at:s] + secrets.MASK
            at = max(at, e)
        assert r.text == out + texts[r.doc_id][at:]


def test_scores_of_any_magnitude(spark):
    rows = [(0, [1.0, 0.5]), (1, [1e-200, 1e-200]), (2, [1e200, 1e200]), (3, [1.0, 1.0]), (4, [-1e-300, 1e-300]), (5, [1e200, 0.0]), (6, [3.0, 3.0])]
    got: dict = {}
    for r in ann.nearest_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_step=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))

    def cosine(x, y):
        x, y = ([v / max(map(abs, w)) for v in w] for w in (x, y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / (math.hypot(*x) * math.hypot(*y))

    for q, x in rows:
        of = {i: cosine(x, y) for i, y in rows if i != q}
        assert [round(s, 12) for _, _, s in sorted(got[q])] == sorted((round(s, 12) for s in of.values()), reverse=True)[:5]
        assert all(abs(s - of[v]) < 1e-12 for _, v, s in got[q])
        assert all(math.isfinite(s) for _, _, s in got[q])
