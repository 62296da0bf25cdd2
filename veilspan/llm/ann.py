"""Approximate nearest neighbours: an NN-descent graph from Spark joins, greedy search for queries.

Equal vectors are one node (the smallest vec_id stands for it), so that thousands of copies do not
fill each other's lists. The graph starts from blocks of neighbours in the order of a few hashed
codes; then each round joins every node's neighbours (both directions) with one another and keeps
the nearest DEGREE of each node. Queries walk the graph: each step expands the best nodes not yet
expanded, until the best BEAM are all expanded. Found nodes are expanded to their rows and ranked
by cosine in double precision on the original vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those whose dimension is not the most frequent one (ties: the smaller). Ties go to the smaller
vec_id. Repeated rows with one vec_id count once. With fewer candidates than wanted, all are
returned; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm import common

DEGREE, ROUNDS = 32, 3
BLOCK, ORDERS, BITS = 256, 3, 14  # size of starting blocks, how many orders, code bits
PER_JOIN = 12  # best new neighbours that one local join offers to a node
BEAM, EXPAND, RERANK = 128, 48, 32  # nodes kept and expanded by a walk, nodes ranked exactly after it
RANGE_ROWS = 8_192  # rows of one sorted range that starting blocks are cut from
PART_NODES = 2_000  # nodes in one part of the table that walks look up vectors in
NEAREST, QUERY_STEP = 5, 50


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    v = v.where("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(embedding, x -> x <> 0)")
    sizes = v.groupBy(F.size("embedding").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    v = v.where(F.size("embedding") == (sizes[0]["s"] if sizes else 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component, which changes no digit; their squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(col: pd.Series) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 1))
    x = _scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        vec = [x.tobytes() for x in _units(b["embedding"])]
        yield pd.DataFrame({"node": b["node"], "vec": vec, "small": [_small(v) for v in vec]})


def _small(vec: bytes) -> bytes:
    """A unit vector in one byte per component after its scale: enough to build the graph with."""
    x = np.frombuffer(vec, "<f4")
    scale = np.float32(np.abs(x).max() / 127)
    return scale.tobytes() + np.round(x / scale).astype(np.int8).tobytes()


def _small_matrix(vecs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(vecs), np.int8).reshape(len(vecs), -1)
    return raw[:, 4:].astype("f4") * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _matrix(vecs: list[bytes] | pd.Series) -> np.ndarray:
    vecs = list(vecs)
    return np.frombuffer(b"".join(vecs), "<f4").reshape(len(vecs), -1)


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sort key for each order: sign bits of random directions, then one projection."""
    for b in batches:
        if not len(b):
            continue
        x = _matrix(b["vec"])
        rng = np.random.default_rng(x.shape[1])
        for o in range(ORDERS):
            p = x @ rng.normal(size=(x.shape[1], BITS + 1)).astype("<f4")
            code = ((p[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])).astype(float)
            yield pd.DataFrame({"ord": o, "key": code + 1 / (1 + np.exp(-p[:, BITS].astype(float))), "node": b["node"], "vec": b["vec"]})


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> Iterator[tuple]:
    k = min(k, len(ids) - 1)
    if k > 0:
        best = np.argpartition(-sims, k - 1, 1)[:, :k]
        for i, row in enumerate(best):
            for j in row:
                yield int(ids[i]), int(ids[j]), float(sims[i, j])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nearest neighbours inside consecutive blocks of the sorted order."""
    hold = pd.DataFrame(columns=["ord", "node", "vec"])
    for b in batches:
        hold = pd.concat([hold, b[["ord", "node", "vec"]]], ignore_index=True) if len(hold) else b[["ord", "node", "vec"]].reset_index(drop=True)
        while len(hold) >= 2 * BLOCK:
            yield _edges(hold.iloc[:BLOCK])
            hold = hold.iloc[BLOCK:].reset_index(drop=True)
    if len(hold):
        yield _edges(hold)


def _edges(block: pd.DataFrame) -> pd.DataFrame:
    rows: list[tuple] = []
    for _, own in block.groupby("ord"):
        ids, x = own["node"].to_numpy(np.int64), _matrix(own["vec"])
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        rows += _top(ids, sims, DEGREE)
    return pd.DataFrame(rows, columns=["a", "b", "s"])


def _local_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs among the neighbours of one node that are nearer than what either has."""
    for b in batches:
        out: list[pd.DataFrame] = []
        for ids, vecs, worst in zip(b["ids"], b["vecs"], b["worst"], strict=True):
            if len(ids) < 2:
                continue
            x = _small_matrix(list(vecs))
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            k = min(PER_JOIN, len(ids) - 1)
            best = np.argpartition(-sims, k - 1, 1)[:, :k]
            s = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(s > np.asarray(worst, "f4")[:, None])
            ids = np.asarray(ids, np.int64)
            out.append(pd.DataFrame({"a": ids[i], "b": ids[best[i, j]], "s": s[i, j].astype(float)}))
        yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "s": []}).astype({"a": "int64", "b": "int64"})


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a, of distinct pairs."""
    e = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return e.withColumn("r", rank).where(F.col("r") <= k).select("a", "b", "s")


def both_ways(graph: DataFrame) -> DataFrame:
    """(v, a): the neighbours of v, and the DEGREE nearest of those that have v as neighbour."""
    back = graph.select(F.col("b").alias("v"), F.col("a").alias("n"), "s")
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "n"))
    back = back.withColumn("r", rank).where(F.col("r") <= DEGREE).select("v", F.col("n").alias("a"))
    return graph.select(F.col("a").alias("v"), F.col("b").alias("a")).union(back).distinct()


def build(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, s): the neighbour graph over (node, vec)."""
    n = max(1, -(-nodes.count() * ORDERS // RANGE_ROWS))
    keyed = nodes.select("node", "vec").mapInPandas(_codes, "ord int, key double, node long, vec binary")
    spread = keyed.repartitionByRange(n, "ord", "key", "node").sortWithinPartitions("ord", "key", "node")
    graph = common.cut(_nearest(spread.mapInPandas(_blocks, "a long, b long, s double"), DEGREE), "graph")
    for _ in range(rounds):
        worst = graph.groupBy("a").agg(F.when(F.count("*") >= DEGREE, F.min("s")).otherwise(F.lit(-2.0)).alias("worst"))
        known = nodes.select(F.col("node").alias("a"), "small").join(worst, "a")
        lists = both_ways(graph).join(known, "a").groupBy("v").agg(
            F.collect_list("a").alias("ids"), F.collect_list("small").alias("vecs"), F.collect_list("worst").alias("worst")
        )  # at most 2 * DEGREE entries
        fresh = lists.mapInPandas(_local_join, "a long, b long, s double")
        graph = common.cut(_nearest(graph.union(fresh), DEGREE), "graph")
    return graph


def _look_up(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Scores of the asked nodes of one part that are better than the worst of the asker's full beam."""
    out = []
    if len(nodes) and len(asked):
        nodes = nodes.sort_values("node")
        ids, x = nodes["node"].to_numpy(np.int64), _matrix(nodes["vec"])
        for q, vec, worst, want in zip(asked["q"], asked["qvec"], asked["worst"], asked["want"], strict=True):
            own = np.searchsorted(ids, np.asarray(want, np.int64))
            s = x[own] @ np.frombuffer(vec, "<f4")
            good = s > worst
            out.append(pd.DataFrame({"q": q, "node": ids[own[good]], "s": s[good].astype(float), "open": True}))
    empty = pd.DataFrame({"q": [], "node": [], "s": [], "open": []}).astype({"q": "int64", "node": "int64", "s": float, "open": bool})
    return pd.concat(out) if out else empty


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node, s): the BEAM nodes that a greedy walk from each query's own node ends with.

    queries: (q, node, vec); q is any id, node the node where the walk starts. Walks meet the
    vectors in parts of the node table; a query's vector is sent once to each part it asks.
    """
    near = common.cut(both_ways(graph), "near")
    schema = "q long, node long, s double, open boolean"
    parts = max(1, -(-nodes.count() // PART_NODES))
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")
    table = nodes.select("node", "vec", part).groupBy("part")
    qv = common.cut(queries.select("q", F.col("vec").alias("qvec")), "askers")
    beam = common.cut(queries.select("q", "node", F.lit(1.0).alias("s"), F.lit(True).alias("open")), "beam")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
    best_open = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("open"), F.desc("s"), "node"))
    while True:
        now = beam.withColumn("r", best_open).withColumn("now", F.col("open") & (F.col("r") <= EXPAND)).drop("r")
        step = now.where("now").join(near, F.col("node") == F.col("v")).select("q", F.col("a").alias("node")).distinct()
        step = step.join(beam.select("q", "node"), ["q", "node"], "left_anti")
        worst = beam.groupBy("q").agg(F.when(F.count("*") >= BEAM, F.min("s")).otherwise(F.lit(-2.0)).alias("worst"))
        asked = step.select("q", "node", part).groupBy("q", "part").agg(F.collect_list("node").alias("want"))  # at most 2 * DEGREE * EXPAND
        asked = asked.join(qv, "q").join(worst, "q")
        scored = table.cogroup(asked.groupBy("part")).applyInPandas(_look_up, schema)
        beam = now.select("q", "node", "s", (F.col("open") & ~F.col("now")).alias("open")).union(scored)
        beam = common.cut(beam.withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"), "beam")
        if beam.where("open").isEmpty():
            return beam.select("q", "node", "s")


def nearest_rows(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by query_step."""
    rows = common.cut(usable(vectors), "vectors")
    # the first k + 1 rows of equal vectors are enough for any query
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.withColumn("r", place).where(F.col("r") <= k + 1)
    firsts = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    members = common.cut(kept.join(firsts, "embedding").select("vec_id", "node"), "members")
    nodes = common.cut(firsts.mapInPandas(_unit, "node long, vec binary, small binary"), "nodes")
    graph = build(nodes)
    asked = rows.where(F.col("vec_id") % query_step == 0).join(firsts, "embedding").select(F.col("vec_id").alias("q"), "node", F.col("embedding").alias("qe"))
    asked = common.cut(asked, "queries")
    found = search(nodes, graph, asked.join(nodes, "node").select("q", "node", "vec"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
    found = found.withColumn("r", best).where(F.col("r") <= RERANK)
    pairs = found.join(members, "node").where("vec_id <> q").select("q", "vec_id")
    pairs = pairs.join(asked.select("q", "qe"), "q").join(rows, "vec_id")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (_scaled(np.stack(b[c].to_numpy()).astype(float)) for c in ("qe", "embedding"))
                s = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pd.DataFrame({"query_id": b["q"], "vec_id": b["vec_id"], "score": s})

    scored = pairs.mapInPandas(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(common.read(spark, sf_dir, "embeddings"))
