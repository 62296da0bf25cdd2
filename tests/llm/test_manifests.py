"""Merkle manifest, spelling variants and web archives against brute force."""

import base64
import hashlib
import io
import os
import random
import re
import zipfile
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.llm import merkle, registry, spelling, warc

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@needs_tables
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants", "op13_warc"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert ordered(got) == ordered(want.fetchall())


# --- Merkle manifest ---------------------------------------------------------------------------
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            yield bool(i & 1), (level[i ^ 1] if i ^ 1 < len(level) else "")
            i //= 2

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = [*way(trees[g], i), *way(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for left, d in path:
                folded = sha(d + folded if left else folded + d)
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(d for _, d in path)), folded, folded == top[-1][0]


def manifest(df):
    return merkle.manifest(df).drop("lang", "proof").collect()


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("few", [merkle.FEW_NODES, 0])  # joined by broadcast, and by shuffles
def test_manifest(spark, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW_NODES", few)
    monkeypatch.setattr(merkle, "FEW_TREES", few)
    odd = [(5, "a", None, 3, None), (None, "é", "x", None, "t"), (5, "a", None, 3, None), (1, None, "x", 0, ""), (7, "b", "", 1, "ü"), (3, "b", "é", 1, "ü" * 100_000)]
    rows = odd + [(i, "s", f"z{i % 3}", i, f"t{i}") for i in range(100, 1500)] + [(i, "s", "big", i, "") for i in range(2000, 4300)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("tree", "idx", "seg", "id", "n", "part", "at", "digest")})
    assert ordered(manifest(df)) == ordered(brute_manifest(rows))


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], DOC)) == []
    one = [(1, "s", "l", 1, "t")]
    assert ordered(manifest(spark.createDataFrame(one, DOC))) == ordered(brute_manifest(one))


# --- spelling variants -------------------------------------------------------------------------
def one_edit(u, v):
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def all_pairs(words):
    """Near words by one code point left out, in every place."""
    same, less = {}, {}
    for w in words:
        for i in range(len(w)):
            same.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            less.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out = {tuple(sorted((a, b))) for g in same.values() for a in g for b in g if a != b}
    return out | {tuple(sorted((a, k))) for k, g in less.items() if k in words for a in g}


def test_sorted_list():
    rng = random.Random(1)
    for _ in range(500):
        k = rng.choice([3, 6, 8])
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([k, k + 1]))) for _ in range(rng.randint(0, 40))})
        n = range(len(words))
        assert set(spelling.near_in_list(words)) == {(i, j) for i in n for j in n if i < j and one_edit(words[i], words[j])}


@pytest.mark.parametrize("most", [spelling.LIST, 20])  # lists are split until one code point is unknown
def test_pairs_of_long_lists(spark, most):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde") for _ in range(rng.choice([6, 7, 8]))) for _ in range(2500)} | {"prefix" + a + b for a in "abcdefgh" for b in "abcdefgh"}
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == all_pairs(words)


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    near = {w: set() for w in n}
    for a, b in all_pairs(n):
        near[a].add(b)
        near[b].add(a)
    best = {w: min(s, key=lambda x: (-n[x], x)) for w, s in near.items() if s}
    form = {w: best[w] if w in best and n[best[w]] >= 5 * n[w] else None for w in n}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None


def test_variants(spark):
    rng = random.Random(3)
    chain = ["colour " * 2600, "colours " * 250, "coloursé " * 40, "coloursès " * 6, "COLOURX " * 5, "bananas bandnas " * 30, "x×y÷zü " * 9]
    rows = [(i, " ".join(rng.choice(chain[:3]) for _ in range(2))) for i in range(40)] + [(100 + i, c) for i, c in enumerate(chain)] + [(None, None), (None, "colour " * 700), (1, ""), (1, ""), (2, "q" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "id", "m", "l", "s", "pre")})
    assert ordered(spelling.variants(df).collect()) == ordered(brute_variants(rows))
    assert any(r[2] != r[1] and r[1] for r in brute_variants(rows))
    assert spelling.variants(df.limit(0)).collect() == []


# --- web archives ------------------------------------------------------------------------------
def brute_pages(rows):
    place = lambda i: (i is None, i or 0)
    first, used = {}, set()
    for i, html in rows:
        first[html or ""] = min(first.get(html or "", (2, 0)), place(i))
    for i, html in rows:
        h = html or ""
        size, digest = len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if first[h] == place(i) and h not in used:
            used.add(h)
            yield i, size, digest, "response", None
        else:
            yield i, size, digest, "revisit", None if first[h][0] else first[h][1]


PAGE = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/ x\r\nWARC-Type: evil", None), (2, None, ""), (3, "u", "é\r\n\r\n" * 5), (None, "u", "é\r\n\r\n" * 5), (3, "u", "é\r\n\r\n" * 5), (3, "u", "é\r\n\r\n" * 5),
    (9, "v", "é\r\n\r\n" * 5), (4, "q", "x" * 3_000_000), (None, None, "only"),
]


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_RECORDS", 2)
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    monkeypatch.setattr(warc, "COPIES", 1)
    df = spark.createDataFrame(PAGES, PAGE).withColumns({c: F.lit(1) for c in ("key", "n", "first", "copies", "page", "path", "more", "k")})
    packages = warc.write_archives(df.coalesce(1))
    got = warc.read_archives(packages).collect()
    number = lambda x: None if x in ("-", None) else int(x)
    assert ordered((number(r.page), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got) == ordered(brute_pages([(a, c) for a, _, c in PAGES]))
    assert all(r.intact for r in got) and {bytes(r.payload).decode() for r in got if r.payload is not None} == {c or "" for _, _, c in PAGES}
    assert {r.url for r in got} >= {"http://a/%20x%0D%0AWARC-Type:%20evil", None}
    for p in packages.collect():  # any ZIP reader can open a package
        files, path = warc.opened(p.path)
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_archives_without_an_index(spark, tmp_path):
    plain = [warc.record(str(i), "u", warc.digest(b"p%d" % i), 2, b"p%d" % i, None) for i in range(5)]
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("archive/a.warc", b"".join(plain))
        z.writestr("archive/b.warc.gz", b"".join(zlib.compress(r, wbits=31) for r in plain))
        z.writestr("datapackage.json", "{}")
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")).collect()
    assert sorted((r.page, bytes(r.payload)) for r in got) == sorted((str(i), b"p%d" % i) for i in range(5) for _ in "ab")


class InMemory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("before", [b"", b"bytes in front"])
@pytest.mark.parametrize("n", [0, 3, 66_000])  # more than 65,535 entries need ZIP64
def test_directories(before, n):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(n):
            with z.open(f"m{i}é" if i % 2 else f"m{i}", "w", force_zip64=i == 1) as f:
                f.write(b"data%d" % i)
        z.comment = b"PK\x05\x06 in a comment"
    p = warc.Package(InMemory(before + out.getvalue()))
    members = list(p.members())
    assert [m.name for m in members] == [f"m{i}é" if i % 2 else f"m{i}" for i in range(n)]
    assert all(p.at(p.data(m), m.size) == b"data%d" % i for i, m in list(enumerate(members))[:: max(1, n // 50)])


def test_wide_entries():
    """Sizes and offsets that only the ZIP64 field holds."""
    p = warc.Package.__new__(warc.Package)
    extra = b"\x07\x00\x01\x00x" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (7 << 32).to_bytes(8, "little")
    assert p._wide(extra, 0xFFFFFFFF, 12, 0xFFFFFFFF) == [5 << 32, 12, 7 << 32]


@pytest.mark.parametrize("data", [b"", b"no archive", b"PK\x05\x06"])
def test_no_archive(data):
    with pytest.raises(ValueError):
        warc.Package(InMemory(data))
