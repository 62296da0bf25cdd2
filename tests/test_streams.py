"""Review histories as streaming state, partial findings, and recognisers that fail."""

import random

import pytest

from veilspan.operators import faults, resolve, review
from veilspan.streaming import live

OPS = ["add", "addManual", "deselect", "select", "delete", "undo", "redo", "deselectAll", "selectAll"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def events(n, docs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(docs), i, rng.choice(OPS), f"k{rng.randrange(5)}") for i in range(n)]


SCHEMA = "doc_id long, seq long, op string, key string"


def test_history_is_saved_whole():
    rng = random.Random(4)
    for _ in range(50):
        h = review.History()
        commands = [(rng.choice(OPS), f"k{rng.randrange(4)}") for _ in range(300)]
        for op, key in commands:
            h = review.History(h.saved())
            h.apply(op, key)
        assert h.rows() == review.run_commands(commands)
        assert len(h.undo) <= review.HISTORY


@pytest.mark.parametrize("sizes", [[400], [1, 7, 150, 242]])
def test_review_stream_on_any_batching(rocks, tmp_path, sizes):
    """Each batch is a run of its own from the checkpoint, so every batch is a restart."""
    spark, rows = rocks, events(400, 6)
    at, source = 0, tmp_path / "in"
    for i, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], SCHEMA).repartition(2).write.mode("append").parquet(str(source))
        at += n
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))

        def keep(batch, number, i=i):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/run={i}/batch={number}")

        live.review_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = live.current(spark.read.parquet(f"{tmp_path}/out").select("doc_id", "seq", "position", "key", "manual", "selected"))
    want = review.replay(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partial_findings(spark, tmp_path):
    texts = {1: "mail ada@example.org\n" * 3, 2: "carta 4111 1111 1111 1111 di Bianchi Mario\npoi BIANCHI", 3: "niente"}
    segments = [(d, i, t[i : i + 25]) for d, t in texts.items() for i in range(0, len(t), 25)]
    schema = "doc_id long, at int, text string"
    source, out = tmp_path / "in", f"{tmp_path}/out"
    for part in (segments[:2], segments[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        live.start_partial(spark.readStream.schema(schema).parquet(str(source)), out, f"{tmp_path}/c", ["email", "payment-card"]).awaitTermination()
    once = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()))
    assert once
    # a batch that is done again after a failure, as its folder has the batch's number, doubles nothing
    live.start_partial(spark.readStream.schema(schema).parquet(str(source)), out, f"{tmp_path}/c2", ["email", "payment-card"]).awaitTermination()
    partial = spark.read.parquet(out)
    final = resolve.findings(resolve.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).drop("ord")
    shown = live.settled(partial, final).collect()
    keys = [(r.doc_id, r.start, r.end, r.category) for r in shown]
    assert len(keys) == len(set(keys))
    assert {(d, s, e, c) for d, s, e, c, *_ in once} <= set(keys)  # nothing is taken back
    assert {(r.doc_id, r.start, r.end, r.category) for r in final.collect()} <= set(keys)


# --- recognisers that fail ---------------------------------------------------------------------
def models():
    """Two recognisers; functions inside of functions travel to the tasks by value."""

    def steady(text):
        return [(0, 11, "PERSON", 0.95)] if text.startswith("Mario Rossi") else []

    def fragile(text):
        if "boom" in text:
            raise ValueError("cannot read: " + text)
        return steady(text)

    return steady, fragile


DOCS = [(1, "Mario Rossi parla"), (2, "Mario Rossi e boom"), (3, None), (4, "")]


def test_one_of_two_models_fails(spark):
    steady, fragile = models()
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r for r in faults.recognised(df, {"a": steady, "b": fragile}).collect()}
    assert [v.model for v in got[1].votes] == ["a", "b"] and not got[1].errors
    assert [v.model for v in got[2].votes] == ["a"] and [(e.model, e.code) for e in got[2].errors] == [("b", "ValueError")]
    assert not any(r.failed for r in got.values()) and not got[3].votes and not got[3].errors
    stage = faults.model_stage(df, {"a": steady, "b": fragile})
    d = {r.doc_id: r for r in resolve.detect(df, ["email"], model=stage).collect()}
    assert [(c.start, c.end, c.category, c.confidence) for c in d[2].candidates] == [(0, 11, "PERSON", "high")]
    assert not any(r.degraded for r in d.values())


def test_all_models_fail(spark):
    _, fragile = models()
    df = spark.createDataFrame(DOCS + [(5, "boom ada@example.org")], "doc_id long, text string")
    stage = faults.model_stage(df, {"b": fragile, "c": fragile})
    rows = {r.doc_id: r for r in stage.collect()}
    assert rows[2].failed and rows[5].failed and not rows[1].failed
    assert "boom" not in str([r.errors for r in rows.values()])
    d = {r.doc_id: r for r in resolve.detect(df, ["email"], model=stage).collect()}
    assert d[5].degraded and [c.category for c in d[5].candidates] == ["EMAIL"]  # rule findings stay
    assert not d[1].degraded


def test_a_model_that_cannot_be_loaded(spark):
    steady, _ = models()

    def broken():
        raise OSError("no such file: secret")

    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r for r in faults.recognised(df, {"a": lambda: steady, "b": broken}, load=True).collect()}
    assert [(e.model, e.code) for e in got[1].errors] == [("b", "OSError")] and len(got[1].votes) == 1
    assert not faults.recognised(df.limit(0), {"a": steady}).collect()
