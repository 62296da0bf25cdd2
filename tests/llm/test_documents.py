"""Operators on documents against brute force, with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilspan.llm import bpe, common, langid, mixing, neardup, quality, secrets, substring

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Distinct texts, exact and near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (120, 80, 300, 60, 55, 3000)]
    passage = prose(rng, 70)
    texts = [*base, base[0], base[0], base[2].replace("w1 ", "x ", 1), f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}", f"{passage} {prose(rng, 90)}",
             None, "", "  \n ", "one", "a b", "y" * 5000, (prose(rng, 6) + " ") * 30]
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 7 == 3 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[3], None, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs):
    """Extra columns whose names the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("kept", "n_words", "fp", "label", "keep", "class_id", "key", "h", "slot", "ids", "spans", "host", "cuts", "doc")})


OPERATORS = {
    "quality": lambda d: quality.assess(d),
    "near": lambda d: neardup.near_duplicates(d),
    "substring": lambda d: substring.remove_repeats(d),
    "secrets": lambda d: secrets.redact(d.withColumns({c: F.lit("x") for c in ("secret_spans", "secret_base", "row", "n", "start")})),
    "bpe": lambda d: bpe.digests(d),
    "mixing": lambda d: mixing.positions(d.select("doc_id", "source", "text")),
    "language": lambda d: langid.predict(d, langid.fit(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, none, name):
    assert OPERATORS[name](clash(docs)).count() == len(corpus())
    assert OPERATORS[name](none).count() == 0


def test_portions_hold_all_rows_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "PORTION", 10)
    texts = ["abc", None, "x" * 30, "", "abcdef", "abcdef", None]
    out = list(common.portions(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"])]), "t"))
    assert [x for b in out for x in b["t"].to_pylist()] == texts and len(out) > 3


def test_tables_are_deleted(spark, tmp_path):
    import os

    df = common.cut(spark.range(3), "t")
    path = common._CUT[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    kept = list(common._CUT[:-1])
    common._CUT[:] = common._CUT[-1:]
    common.drop_tables(spark)
    common._CUT[:] = kept
    assert not os.path.isdir(path)


# --- quality rules -----------------------------------------------------------------------------
def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for i, t, *_ in corpus():
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {j + k for j in range(len(ws) - 2) if grams[tuple(ws[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def test_frequent_lines_deplete(spark):
    rng = random.Random(1)
    spam = prose(rng, 40)
    rows = [(i, f"{spam}\n{prose(rng, 60 if i < 15 else 14)}", "en", "s", 0) for i in range(30)]
    copy = prose(rng, 80)
    rows += [(100 + i, copy + "\nx", "en", "s", 0) for i in range(40)]  # equal texts are one document
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, SCHEMA), line_docs=5, depleted=0.5).collect()}
    assert all(got[i].kept == (i < 15) and got[i].n_removed_words == 40 for i in range(30))
    assert all(got[100 + i].kept for i in range(40))
    assert quality.keep_good(spark.createDataFrame(rows, SCHEMA)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_lines_counted_by_texts_or_by_ids(spark):
    rng = random.Random(5)
    page = f"{prose(rng, 40)}\n{prose(rng, 20)}"
    rows = [(i, page, "en", "s", 0) for i in range(30)] + [(100 + i, f"{prose(rng, 60)}\n{prose(rng, 9)}", "en", "s", 0) for i in range(9)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)  # a repeated row is no further document
    by_text, by_id = ({r.doc_id: (r.n_removed_words, r.kept) for r in quality.assess(df, line_docs=limit, count=c).collect()} for c, limit in (("texts", 5), ("ids", 29)))
    assert all(v == (0, True) for v in by_text.values())
    assert all(by_id[i] == ((60, False) if i < 30 else (0, True)) for i, *_ in rows)
    assert all(r.kept for r in quality.assess(df, line_docs=30, count="ids").collect())
    with pytest.raises(ValueError):
        quality.assess(df, count="lines")


@pytest.mark.parametrize("common_words", [85, 400])
def test_boilerplate_documents_are_rejected(spark, common_words):
    rng = random.Random(12)
    spam = prose(rng, common_words)
    rows = [(i, f"{spam}\n{prose(rng, 15 * common_words // 100)}", "en", "s", 0) for i in range(300)]
    got = quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300 and all(r.n_removed_words == common_words and not r.kept for r in got)


def test_pipeline_removes_lines_and_states_the_mix(spark):
    import corpus_pipeline

    rng = random.Random(14)
    spam = prose(rng, 20)
    rows = [(i, f"{prose(rng, 30)}\n{spam}\n{prose(rng, 50)}", "en", "src0" if i % 2 else "src5", 7) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.quality_rules(spark, df, "")
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (x := t.replace(spam + "\n", ""), len(x)) for i, t, *_ in rows}
    got = corpus_pipeline.encode(spark, df.repartition(5), "").collect()
    want = {r.doc_id: (r.mix_slot, r.mix_n) for r in mixing.positions(df).collect()}
    assert {r.doc_id: (r.mix_slot, r.mix_n) for r in got} == want and len(set(want.values())) == 60


def test_pipeline_with_nulls_clashes_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    lib = bpe.coder(bpe.default_path()).lib
    odd = {c: F.lit("x") for c in ("mix_slot", "mix_n", "row", "fp", "kept", "secret_spans", "u", "at", "ids")}
    rng = random.Random(40)
    secret = "password=abcdef123456"
    rows = [*corpus(), (50, f"{prose(rng, 60)} {secret}", "en", "src1", 1), (51, prose(rng, 70), None, "src2", None)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, SCHEMA).withColumns(odd).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        if name == "none":
            assert not got
            continue
        # by hand: 50 words or more, few repeated ones; the first of equal or similar texts
        assert set(got) == {0, 1, 2, 3, 4, 5, 9, 10, 50, 51}
        want = {i: t for i, t, *_ in rows} | {50: rows[-2][1].replace(secret, secrets.MASK)}
        for i, r in got.items():
            assert list(r.ids) == [x if x < 2**31 else x - 2**32 for x in lib.encode(want[i], add_special_tokens=False).ids]
        assert len({(r.source, r.mix_n) for r in got.values()}) == len(got)


# --- near duplicates ---------------------------------------------------------------------------
def _similar(a, b):
    x, y = (Counter(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values())) >= 0.8


def test_near_duplicate_classes(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        t = prose(rng, rng.randint(60, 400)).split()
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 5)):
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(len(u))] = "edit"
            texts.append(" ".join(u))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or _similar(texts[i], texts[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = neardup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_near_pairs_among_dissimilar_texts_of_one_bucket(spark, monkeypatch):
    rng = random.Random(6)
    template, texts = prose(rng, 150), []
    for _ in range(300):  # one template, similarity about 0.6, all in one bucket of more than 256 members
        texts.append(f"{template} {prose(rng, 50)}")
    pairs = [(20 * k + 3, 300 + k) for k in range(15)]
    texts += [texts[a].rsplit(" ", 1)[0] + " edit" for a, _ in pairs]
    real = neardup.bands
    monkeypatch.setattr(neardup, "bands", lambda t: ([7] * neardup.BANDS, real(t)[1]))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i for i in range(300)} | {b: a for a, b in pairs}


def test_signature_estimates_weighted_similarity():
    rng = random.Random(2)
    import numpy as np

    e = common.mix(np.arange(300, dtype=np.uint64))
    a = np.array([rng.randint(1, 9) for _ in range(300)])
    b = np.array([x if rng.random() < 0.8 else rng.randint(1, 9) for x in a])
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits = []
    for salt in range(30):
        s = common.mix(e + np.uint64(salt + 1))
        hits.append((neardup.signature(s, a) == neardup.signature(s, b)).mean())
    assert abs(np.mean(hits) - true) < 0.03


def test_repeated_rows_leave_one(docs):
    kept = [r.doc_id for r in neardup.drop_near_duplicates(docs).collect()]
    assert Counter(kept)[0] == 1 and 6 not in kept and 7 not in kept


def test_documents_without_words_stay_with_and_without_repeated_rows(spark):
    empty = [(2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, None, "en", "s", 0)]
    rng = random.Random(30)
    one, other = (1, prose(rng, 60), "en", "s", 0), (4, prose(rng, 60), "en", "s", 0)
    for rows in ([one, other, *empty], [one, one, other, *empty]):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("fp", "row", "keep", "label", "n")})
        out = neardup.drop_near_duplicates(df)
        assert sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3, 4] and out.columns == df.columns


def test_large_classes_with_hot_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "FEW", 10**9)
    rng = random.Random(31)
    base, texts = prose(rng, 200), []
    for i in range(120):  # near copies, and many exact ones of the first
        texts.append(base if i % 3 == 0 else base.rsplit(" ", 1)[0] + f" w{i}x")
    texts += [prose(rng, 80) for _ in range(20)]
    got = {r.doc_id: (r.class_id, r.keep) for r in neardup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert all(got[i] == (0, i == 0) for i in range(120)) and all(got[i] == (i, True) for i in range(120, 140))


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_components_of_stars_and_chains(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)  # 1: every node and class is spread
    monkeypatch.setattr(common, "FEW", 10**9)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(300, 250), (250, 300), (400, 401)]
    got = {r.fp: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(60), 0) | dict.fromkeys(range(100, 131), 100) | {300: 250, 250: 250, 400: 400, 401: 400}
    assert got == want


@pytest.mark.parametrize("hot_rows", [0, 3, 10**6])
def test_skewed_joins_and_splits(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "FEW", 10**9)
    rows = spark.createDataFrame([(k, i) for k, m in ((1, 9), (2, 4), (3, 2), (4, 1)) for i in range(m)], "k long, i long")
    small = spark.createDataFrame([(1, 9), (2, 4), (4, 1), (7, 5)], "k long, n long")
    inside, outside = common.skewed_split(rows, small, ["k"], "n")
    assert Counter(r.k for r in inside.collect()) == {1: 9, 2: 4, 4: 1} and Counter(r.k for r in outside.collect()) == {3: 2}
    assert Counter(r.k for r in common.skewed_join(rows, small, ["k"], "n").collect()) == {1: 9, 2: 4, 4: 1}


# --- substring dedup ---------------------------------------------------------------------------
def removed_by_force(rows):
    first: dict = {}
    for i, t, *_ in rows:
        ws = (t or "").split()
        d = substring.LAST if i is None else i
        for j in range(len(ws) - 49):
            k = tuple(ws[j : j + 50])
            first[k] = min(first.get(k, d), d)
    out = {}
    for i, t, *_ in rows:
        ws = (t or "").split()
        d = substring.LAST if i is None else i
        gone = {j + k for j in range(len(ws) - 49) if first[tuple(ws[j : j + 50])] < d for k in range(50)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out[i] = (len(ws), len(gone), " ".join(kept))
    return out


@pytest.mark.parametrize("hot", [2000, 0])
def test_substring_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)  # 0: every context is sliced
    want = removed_by_force(corpus())
    for r in substring.remove_repeats(docs).collect():
        assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == want[r.doc_id]


def test_passages_at_the_ends_of_texts_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 0)
    monkeypatch.setattr(substring, "SHARD_CONTEXTS", 1)
    rng = random.Random(13)
    rows = []
    for k in range(12):
        passage = prose(rng, 50 + k % 5)
        three = [f"{prose(rng, 60)} {passage}", f"{prose(rng, 30)} {passage} {prose(rng, 60)}", f"{passage} {prose(rng, 60)}"]
        rng.shuffle(three)
        rows += [(3 * k + i, t, "en", "s", 0) for i, t in enumerate(three)]
    want = removed_by_force(rows)
    for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == want[r.doc_id]


def test_one_passage_with_many_edges(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 40)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "FEW", 10**9)
    rng = random.Random(17)
    passage = prose(rng, 75)
    rows = [(i, f"{prose(rng, rng.randint(0, 60))} {passage} {prose(rng, rng.randint(0, 60))}".strip(), "en", "s", 0) for i in range(200)]
    rows += [(200 + i, rows[i % 7][1], "en", "s", 0) for i in range(60)]
    want = removed_by_force(rows)
    for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == want[r.doc_id]


def test_backward_search_equals_counting():
    import numpy as np

    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 5, 400)
    symbols[-1] = 0
    docs = rng.integers(0, 50, 400)
    index = substring.FMIndex(symbols, docs)
    place = np.arange(300)
    lo, hi = index.seeded(place)
    for i in place:
        assert hi[i] - lo[i] == sum((symbols[j : j + index.seed] == symbols[i : i + index.seed]).all() for j in range(401 - index.seed))
    for n in (1, 2, 3, 5, 9):
        for _ in range(40):
            p = rng.integers(1, 5, n)
            lo, hi = np.array([0]), np.array([400])
            for s in p[::-1]:
                lo, hi = index.extend(lo, hi, np.array([s]))
            at = [i for i in range(400 - n) if (symbols[i : i + n] == p).all()]
            assert hi[0] - lo[0] == len(at)
            assert index.earliest(lo, hi)[0] == (min(docs[i] for i in at) if at else substring.NONE)


# --- secrets -----------------------------------------------------------------------------------
ASSIGN = re.compile(secrets.ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(password|passwd|secret|token|api_?key)"), re.I | re.A)


def base_by_force(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_spans(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = ["identifier", "connection", "configuration", "parameter", "directory", "structure", "character", "position"]
    texts = ['😀 api_key = "abcDEF123456" x', "Password:short", "token: secret=abcdef", f"AKIA{'A1' * 8} AKIA{'B' * 10}", "deadbeef" * 3, "ſecret=abcdefgh", None, ""]
    texts += [" ".join(rng.choice(plain) + rng.choice(plain) + rng.choice(plain) for _ in range(60)) for _ in range(30)]
    texts += [f"token={''.join(rng.choice('0123456789abcdef') for _ in range(40))}" for _ in range(30)]
    loose = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(20)]
    texts += [f"see {s} here" for s in loose]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    rows = secrets.scan(df.select("doc_id", "text")).select("doc_id", "text", secrets._joined("secret_base").alias("base"), secrets._joined("secret_spans").alias("spans")).collect()
    for r in rows:
        assert r.base == base_by_force(r.text or "")
        assert set(r.base.split(",")) <= set(r.spans.split(",")) | {""}
    found = {r.doc_id for r in rows if "random" in r.spans}
    random_ids = set(range(len(texts) - 20, len(texts)))
    assert len(found & random_ids) >= 19 and not found - random_ids
    masked = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert masked[0].text == '😀 [SECRET]" x' and masked[0].n_chars == len(masked[0].text) and masked[1].text == "Password:short" and masked[6].text is None


def test_method_spans_equal_a_plain_model(spark):
    rng = random.Random(21)
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    texts = []
    for i in range(80):
        parts = [rng.choice(["snake_case_identifier_name", "CamelCaseClassName2", "https", "connection"]) + rng.choice(["", "-handler", "_list"]) for _ in range(20)]
        parts += ["".join(rng.choice(pool) for _ in range(rng.randint(15, 40))) for _ in range(2)]
        if i % 2:
            parts.append("token=" + "".join(rng.choice(pool[:62]) for _ in range(30)))
        rng.shuffle(parts)
        texts.append(rng.choice(["", "😀é "]) + " ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = secrets.train(df)
    got = {r.doc_id: r.spans for r in secrets.scan(df, table).select("doc_id", secrets._joined("secret_spans").alias("spans")).collect()}
    added = 0
    for i, t in enumerate(texts):
        spans = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base_by_force(t).split(",") if x)]
        base = list(spans)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            v = m[0]
            if len(v) >= 20 and not any(a < m.end() and m.start() < b for a, _, b in base):
                score = sum(round(table[(ord(x) - 33) * 94 + ord(y) - 33], 6) for x, y in zip(v, v[1:], strict=False)) / (len(v) - 1)
                if score > secrets.THRESHOLD:
                    spans.append((m.start(), 3, m.end()))
                    added += 1
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert added > 40


# --- mixing ------------------------------------------------------------------------------------
@pytest.mark.parametrize(("sources", "rows"), [(5, 4000), (1000, 9000)])
def test_mixing_is_pfair(spark, sources, rows):
    from fractions import Fraction

    rows = [(i, f"t{i}", "en", f"src{i % sources if i % 2 else 0}", 1) for i in range(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = {"src0": 3.0, "src4": 0.0, "src1": 0.7}
    p = mixing.positions(df, weights=weights, block_docs=2).collect()
    blocks = {(r.mix_source, r.mix_block): r for r in p if r.mix_slot is not None}
    slots = sorted(r.mix_slot for r in blocks.values())
    assert len(set(slots)) == len(slots)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in blocks.values())
    assert {r.mix_source for r in p if r.mix_slot is None} <= {"src4"}
    # while all sources last, none is a block from its exact target
    names = {r.mix_source for r in blocks.values()}
    total = sum(Fraction(str(weights.get(s, 1.0))) for s in names)
    share = {s: Fraction(str(weights.get(s, 1.0))) / total for s in names}
    by_slot = {r.mix_slot: r.mix_source for r in blocks.values()}
    given, ends = Counter(), min(max(r.mix_slot for k, r in blocks.items() if k[0] == s) for s in names)
    for t in range(ends):
        given[by_slot[t]] += 1
        assert all(abs(given[s] - (t + 1) * w) < 1 for s, w in share.items())
    numbers = defaultdict(list)
    for r in p:
        numbers[r.mix_source].append(r.mix_n)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())


def test_interleaving_keeps_rows_of_any_names(spark, docs, none):
    odd = docs.withColumns({c: F.lit("x") for c in ("u", "at", "mix_slot", "mix_n", "row", "s", "h", "n")})
    out = mixing.interleave(odd)
    assert out.columns == odd.columns and out.count() == len(corpus()) and out.where("at = 'x' and mix_slot = 'x'").count() == len(corpus())
    assert mixing.interleave(none).count() == 0
    lost = spark.createDataFrame([(None, None, None, None, None), (1, "a", "en", None, 1)], SCHEMA)
    assert {r.mix_source for r in mixing.positions(lost).collect()} == {""}


# --- BPE ---------------------------------------------------------------------------------------
def test_bpe_equals_the_library(docs):
    lib = bpe.coder(bpe.default_path()).lib
    rng = random.Random(9)
    alphabet = "abcdefghinorst  éßÄ́'s0123.,#\n\x1c\x85 İΣ漢字👍​²ªµ_"
    texts = [t for _, t, *_ in corpus()]
    texts += ["".join(rng.choice(alphabet) if rng.random() < 0.95 else rng.choice(["<|endoftext|>", "<|", "'LL"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for unit in ("ab", "aaaab", "theinreon", "éa", "!#", "a"):
        texts.append("".join(rng.choice(unit) for _ in range(4000)))
    c = bpe.coder(bpe.default_path())
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(memoryview(c.encode(t)).cast("I")) == ids
        assert c.decode(__import__("numpy").array(ids, "u4")) == lib.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_documents(docs).collect():
        assert r.n_tokens * 4 == len(r.ids)


@pytest.mark.parametrize("size", [30, 64, 500])
def test_pieces_joined_equal_the_library(spark, monkeypatch, size):
    monkeypatch.setattr(bpe, "PIECE", size)
    lib = bpe.coder(bpe.default_path()).lib
    rng = random.Random(size)
    alphabet = "abcdefghinorst  éßÄ́'s0123.,#\n\x1c\x85 İΣ漢字👍​²ªµ_"
    texts = [t for _, t, *_ in corpus()]
    for _ in range(60):
        texts.append("".join(rng.choice(alphabet) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "<|", "'LL"]) for _ in range(rng.randint(0, 900))))
    for unit in ("ab", "aaaab", "theinreon", "éa", "!#", "a", "THe", "it's", "abc1"):
        texts.append("".join(rng.choice(unit) for _ in range(3000)))
        texts.append("x " + "".join(rng.choice(unit) for _ in range(700)) + " yy" * 300)
    for t in texts:
        c, parts = bpe.coder(bpe.default_path()), [t[i : i + size] for i in range(0, len(t or ""), size)]
        if parts:
            assert list(memoryview(c.concatenated([c.piece(x) for x in parts])).cast("I")) == lib.encode(t, add_special_tokens=False).ids
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0)] * 2
    got = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert list(memoryview(bytes(r.ids)).cast("I")) == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


# --- language ----------------------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(8)
    forms = {"aa": ["ka", "lo", "mi"], "bb": ["stro", "pfen", "icht"], "cc": ["eux", "ois", "ille"]}
    rows = [(i, " ".join("".join(rng.choice(forms[y]) for _ in range(3)) for _ in range(30)), y, "s", 0) for i in range(300) for y in [list(forms)[i % 3]]]
    rows += [(1000, None, "aa", "s", 0), (1001, "123 456 !!", "aa", "s", 0), (1002, "KALOMI kamilo " * 5000, None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    held = [r for r in rows if r[0] < 1000 and got[r[0]].held_out]
    assert len(held) > 40 and all(got[r[0]].lang_pred == r[2] for r in held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0 and got[1002].lang_pred == "aa"
    import zlib

    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)


def test_digest_of_kept_words(docs):
    r = substring.remove_repeats(docs).where("doc_id = 0").select(F.sha2("kept", 256).alias("s")).first()
    assert r.s == hashlib.sha256(corpus()[0][1].encode()).hexdigest()
