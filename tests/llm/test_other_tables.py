"""Operators on embeddings, pages and conversations, and the registered queries and pipeline."""

import hashlib
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from veilspan.llm import ann, chat, registry, urlfilter

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- nearest neighbours ------------------------------------------------------------------------
def exact_neighbours(rows, step=5, k=5):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for a, i in enumerate(ids):
        if i % step == 0:
            s = x @ x[a] / (n * n[a])
            out[i] = sorted(((-round(float(s[b]), 12), j) for b, j in enumerate(ids) if j != i))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # copies
    bad = [(1000, None), (1005, [0.0] * 12), (1010, [float("nan")] + [1.0] * 11), (1015, [None] + [1.0] * 11), (1020, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest_rows(df, query_step=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact_neighbours(rows)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [v for _, v, _ in sorted(got[410])] == [7, 400, 401, 402, 403]  # ties: smaller ids first
    assert all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_a_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got: dict = {}
    for r in ann.op7_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact_neighbours(rows, ann.QUERY_STEP)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(10)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("node", "q", "s", "rank", "vec", "score", "part")})
    got = ann.nearest_rows(df, query_step=5).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in (0, 5) for k in range(1, 6)] and all(r.vec_id != r.query_id for r in got)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in ann.nearest_rows(df).collect()] == [(0, 3, 0.707107)]
    assert ann.nearest_rows(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- chat --------------------------------------------------------------------------------------
LOG = "conv_id long, turn long, seq long, kind string, role string, text string"


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 3, "regenerate", "assistant", "Hey"),
        (1, 1, 4, "delta", "assistant", " you"), (1, 0, 5, "edit", "user", "hi!"), (2, 0, 0, None, None, None), (2, 0, 0, "message", "user", "tie"), (None, 0, 0, "message", "user", "x"),
    ]
    got = {(r.conv_id, r.turn, r.role, chat.parse(r.formatted)[0][1]) for r in chat.format_turns(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(1, 0, "user", "hi!"), (1, 1, "assistant", "Hey you"), (2, 0, "user", ""), (2, 0, "user", "tie"), (None, 0, "user", "x")}


@pytest.mark.parametrize("text", ["", chat.CONTROL, "</turn>\n<turn user>\n", "a\\b\\l<turn", "####\\h", "x" * 100_000])
@pytest.mark.parametrize("role", ["user", "assistant", "odd>role\\"])
def test_rendering_is_reversible(role, text):
    out = chat.render(role, text)
    assert [(r, t) for r, t, _, _ in chat.parse(out)] == [(role, text)]
    assert [chat.unescape(out[a:b]) for a, b in chat.loss_spans(out)] == ([text] if role == "assistant" else [])


def test_null_turns_unknown_kinds_and_clashing_names(spark):
    rows = [(1, None, 0, "message", "user", "first"), (1, 0, 1, "nonsense", "assistant", "second"), (1, 0, 2, "delta", "assistant", "!")]
    df = spark.createDataFrame(rows, LOG).withColumns({c: F.lit("x") for c in ("formatted", "n_turns", "piece")})
    got = [(r.turn, r.role, chat.parse(r.formatted)[0][1]) for r in chat.format_turns(df).collect()]
    assert got == [(None, "user", "first"), (0, "assistant", "second!")]  # unknown kinds are messages, null turns come first


def test_digests(spark):
    rows = [(5, t, 0, "message", "assistant" if t % 2 else "user", f"é{t}") for t in range(6)]
    r = chat.digests(spark.createDataFrame(rows, LOG)).first()
    turns = "".join(f"{x[4]}\n{x[5]}\n" for x in rows)
    loss = "".join(x[5] for x in rows if x[4] == "assistant")
    assert (r.n_turns, r.turns_sha256) == (6, hashlib.sha256(turns.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert r.formatted_chars == sum(len(chat.render(x[4], x[5])) for x in rows)
    assert chat.digests(spark.createDataFrame([], LOG)).count() == 0


# --- URLs --------------------------------------------------------------------------------------
def test_rules_and_parts(spark):
    urls = ["HTTPS://A.Example.NET/en/x?y#z", "http://b.example.net/de/", "https://example.com/de/1", "https://notexample.com/de/", "http://x.org/fr/?q", "http://net/", "http://xnet/",
            "no scheme", None, "", "://", "http://É.org?x/y", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "<p>", "x", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("example.com/de/", "block") and got[3][2] is None
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2] == "net/" and got[6][2] is None
    assert all(got[i][:3] == ("", "", None) and got[i][3] in ("allow", "block") for i in (7, 8, 9, 10))
    assert got[11][:2] == ("É.org", "") and got[12][:2] == ("b:", "//c/d")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_trees_learn_held_out_urls():
    rng = np.random.default_rng(1)

    def make(bad):
        host = f"{'buy-' if bad else ''}{rng.choice(['alpha', 'beta', 'gamma'])}{rng.integers(0, 999) if bad else ''}.com"
        path = "/" + "/".join(str(rng.integers(0, 9)) for _ in range(rng.integers(1, 5)))
        return f"http://{host}{path}" + ("?a=1&b=2" if bad else ""), host, path

    y = [int(i % 3 == 0) for i in range(900)]
    rows = [make(v) for v in y]
    m = urlfilter.train(rows[:600], y[:600])
    right = ((m.score(m.matrix(rows[600:])) >= 0.5).astype(int) == y[600:]).mean()
    assert right > 0.97
    assert urlfilter.train([], []).score(np.zeros((1, 18)))[0] < 0.5


def test_urls_of_any_shape_and_repeated_rows(spark):
    rows = [(1, "http://casino-x.example.com/a")] * 3 + [(None, None), (2, "http://fine.example.com/a" + "b" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "block_score", "html")})
    got = urlfilter.judge(df).collect()
    assert len(got) == 5 and len({(r.page_id, r.verdict) for r in got}) == 3


SF01 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test tables")
def test_trees_on_held_out_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    m = urlfilter.fit(urlfilter.by_host_words(pages))
    held = [(r.url, r.verdict) for r in urlfilter.by_host_words(pages).where(urlfilter.held_out(F.col("url"))).collect()]
    parts = {r.url: (r.url, r.host, r.path) for r in urlfilter.parts(pages).collect()}
    block = m.score(m.matrix([parts[u] for u, _ in held])) >= 0.5
    truth = np.array([v == "block" for _, v in held])
    assert len(held) > 400 and truth.sum() > 5
    assert (block & truth).sum() >= 0.8 * truth.sum() and (block & ~truth).sum() <= 0.01 * len(held)


def test_labels_from_pages(spark):
    rng = np.random.default_rng(3)

    def page(bad):
        words = ["x%%%", "$$$", "y"] * 20 if bad else [f"w{rng.integers(0, 500)}" for _ in range(60)]
        return f"<html><script>var a = '#|#|';</script><!-- {'$ ' * 99}--><p>{' '.join(words)}</p><a href=x>y</a></html>"

    bad = [i % 4 == 0 for i in range(800)]
    rows = [(i, f"http://site{i % 40}.com/{'offer-' if b else ''}{i}", page(b)) for i, b in enumerate(bad)]
    rows += [(900, "http://a.com/empty", None), (901, None, page(True)), (902, "no scheme", page(True)), (903, "http://a.com/links", "<a href=x>one two</a> " * 40)]
    rows += [(904, "http://a.com/same", "<p>" + "buy now " * 50), (905, "http://a.com/long", page(False) + "<p>" + " ".join(f"v{i}" for i in range(50_000)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("verdict", "links", "text", "w", "host")})
    got = {r.url: r.verdict for r in urlfilter.by_page_content(df).collect()}
    assert None not in got and "no scheme" not in got and len(got) == 804
    assert all((got[u] == "block") == b for (_, u, _), b in zip(rows, bad, strict=False))
    assert [got[f"http://a.com/{x}"] for x in ("empty", "links", "same", "long")] == ["block", "block", "block", "allow"]
    r = urlfilter.held_out_report(df, urlfilter.by_page_content(df)).first()
    assert r.urls > 150 and r.to_block > 30 and r.rightly >= 0.9 * r.to_block and r.blocked - r.rightly <= 0.05 * r.urls
    assert urlfilter.held_out_report(df.limit(0), urlfilter.by_page_content(df.limit(0))).first().urls == 0


# --- registered queries ------------------------------------------------------------------------
@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    # values as they are: in pandas a column of whole numbers with nulls has another type on each side
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "encode"]
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(ids) < docs.count() and out.columns[:3] == ["doc_id", "source", "n_tokens"]
