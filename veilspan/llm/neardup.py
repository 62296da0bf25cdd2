"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

A document is the weighted set of its 5-word shingles (weight: how often it occurs; a text of
fewer words is one shingle). Darts are hashed into dyadic regions of (element, weight, rank), so
that all documents see the same darts; a document keeps those below its weights, and of each of K
coordinates the earliest. Signatures are cut into bands; documents that share a band are
candidates, and pairs are verified by their weighted Jaccard similarity over all shingles.

Equal texts are one node from the start. In each bucket only pivots are compared with the other
members: members in the pivots' components are decided, the others become pivots in ROUNDS later
rounds, about as many at once as keep the comparisons of a bucket near ROUND_PAIRS. What is then left in
buckets of two components or more is settled exactly by a prefix filter: of two similar texts, the
first shared element in any fixed order lies among the first fifth of both, so that texts of
different components meet by those elements, rare ones first. The order comes from a sample; only
the number of pairs depends on it, not the links. Components are found by minimum labels with
pointer jumping over tables in the shared folder.

Result: doc_id and class_id, the smallest doc_id of the class. Nulls: null or empty text (no
words) is a class of its own, as is every row in it; null doc_ids are grouped by text and have
class_id null only if no member has an id. Repeated rows are copies. Empty tables give empty
results. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 20
K = ROWS * BANDS
DARTS = K * math.log(K) + 2 * K  # expected darts that fill all coordinates
PIVOTS, ROUND_PAIRS, ROUNDS = 32, 512, 2  # pivots and comparisons of a bucket in a later round, rounds before the prefix filter
RANKED_TEXTS, RANKED = 5_000, 300_000  # texts of the sample that orders elements, and elements it tells apart from rare ones
LAST = 2**63 - 1
LOW = -1  # the lowest rank region is [0, 2**LOW): few regions matter more than spare darts of long texts
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(512)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    logs = n * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in n])
    return np.cumsum(np.exp(logs))


def _region(elements: np.ndarray, counts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinate, rank, dart) of the darts with ranks in one region that fall below the weights."""
    low, width = (0.0, 2.0**band) if band == LOW else (2.0 ** (band - 1), 2.0 ** (band - 1))
    found = []
    nu = 0
    while True:
        w_low, w_width = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
        own = elements if nu == 0 else elements[counts > w_low]
        if not len(own):
            break
        weight = counts if nu == 0 else counts[counts > w_low]
        seed = common.mix(own ^ common.mix(np.array([(nu + 1) << 16 | (band + 512)], np.uint64)))
        u = (seed >> np.uint64(11)).astype(float) * 2.0**-53
        n = np.searchsorted(_poisson(width * w_width), u, "right")
        at = np.repeat(np.arange(len(own)), n)
        if len(at):
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = common.mix(seed[at] + (nth + 1).astype(np.uint64) * _GOLD)
            rank = low + width * 2.0**-40 * (dart >> np.uint64(24)).astype(float)  # the other 24 bits choose the coordinate
            if nu:  # weights are at least 1, so that darts of the lowest region always hit
                height = w_low + w_width * (common.mix(dart + np.uint64(2)) >> np.uint64(11)).astype(float) * 2.0**-53
                hit = height < weight[at]
                dart, rank = dart[hit], rank[hit]
            found.append((dart, rank))
        nu += 1
    dart = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    rank = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
    return (dart & np.uint64(0xFFFFFF)) % np.uint64(K), rank, dart


def signature(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """K coordinates of a weighted set: the earliest dart of each."""
    top = max(LOW, math.ceil(math.log2(DARTS / counts.sum())))
    got = [_region(elements, counts, b) for b in range(LOW, top + 1)]
    while True:
        coord, rank, dart = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(rank, kind="stable")
        full, first = np.unique(coord[order], return_index=True)
        if len(full) == K:
            return dart[order][first]
        top += 1  # all darts of lower ranks are known; later ones cannot be earlier
        got.append(_region(elements, counts, top))


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, from the hashes of its words, and how often each occurs."""
    return np.unique(common.shingles(h, min(SHINGLE, max(1, len(h)))), return_counts=True)


def bands(h: np.ndarray) -> tuple[list[int], int]:
    """One 64-bit bucket per band, and the number of shingles; none for a text without words."""
    elements, counts = weighted(h)
    if not len(elements):
        return [], 0
    s = signature(elements, counts).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for i in range(ROWS):
        key = key * _GOLD + s[:, i]
    return common.mix(key).astype(np.int64).tolist(), int(counts.sum())


def members(h: np.ndarray) -> bytes:
    """Sorted 32-bit hashes of (shingle, which occurrence): weighted similarity is set similarity of these."""
    elements, counts = weighted(h)
    at = np.repeat(np.arange(len(elements)), counts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort((common.mix(elements[at] + nth.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype("<u4")).tobytes()


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    w = common.Words(texts)
    return np.split(w.hashes(), w.first[1:-1]) if len(texts) else []


def similar(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    # two equal 32-bit hashes inside one text would count as shared: take each value of a text once more only if both have it
    both = int((merged[1:] == merged[:-1]).sum()) - int((x[1:] == x[:-1]).sum()) - int((y[1:] == y[:-1]).sum())
    return both / max(1, len(x) + len(y) - both)


def fingerprint(text: Column) -> Column:
    """64 bits of the text, in the JVM; null for a text without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text, F.lit(1)))


def nodes(docs: DataFrame) -> DataFrame:
    """(fp, doc_id) of every document."""
    return docs.select(fingerprint(F.col("text")).alias("fp"), F.col("doc_id").cast("long").alias("doc_id"))


def buckets(docs: DataFrame) -> DataFrame:
    """(fp, h, size): the buckets of each distinct text and its number of shingles, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.portions(batches, "text"):
            got = [bands(h) for h in word_hashes(b["text"])]
            some = [i for i, g in enumerate(got) if g[1]]
            keys = np.array([got[i][0] for i in some], np.int64).ravel()
            fp = b["fp"].take(pa.array(np.repeat(np.array(some, np.int64), BANDS)))
            yield pa.RecordBatch.from_arrays([fp, pa.array(keys), pa.array(np.repeat(np.array([got[i][1] for i in some], np.int64), BANDS))], ["fp", "h", "size"])

    src = docs.select(fingerprint(F.col("text")).alias("fp"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "fp long, h long, size long").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, s): the shingles of the texts in wanted (fp); copies of one text have one set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["fp"], pa.array([members(h) for h in word_hashes(b["text"])], pa.binary())], ["fp", "s"])

    texts = docs.select(fingerprint(F.col("text")).alias("fp"), F.col("text").cast("string").alias("text"))
    one = texts.join(wanted, "fp", "left_semi").mapInArrow(sets, "fp long, s binary")
    return one.groupBy("fp").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose texts are similar enough."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.fromiter((similar(x, y) >= SIMILARITY for x, y in zip(b["sa"], b["sb"], strict=True)), bool, len(b))
            yield b.loc[ok, ["a", "b"]]

    left = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInPandas(test, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest node of each component, for nodes with an edge."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = common.cut(both.union(both.select("v", "u")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("fp")).agg(F.least(F.first("u"), F.min("v")).alias("label"), F.count("*").alias("links"))
    labels = common.cut(labels, "labels")
    while True:
        # a hub has many links, a class many nodes: both are spread
        near = common.skewed_join(both, labels.select(F.col("fp").alias("v"), "label", F.col("links").alias("n")), ["v"], "n")
        near = near.groupBy(F.col("u").alias("fp")).agg(F.min("label").alias("near"))
        step = common.cut(labels.join(near, "fp").select("fp", "links", F.col("label").alias("was"), F.least("label", "near").alias("label")), "near")
        jump = labels.select(F.col("fp").alias("label"), F.col("label").alias("far")).join(step.groupBy("label").agg(F.count("*").alias("n")), "label")
        step = common.skewed_join(step, common.cut(jump, "jump"), ["label"], "n")
        step = step.select("fp", "links", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("was")).alias("moved"))
        step = common.cut(step, "labels")
        labels = step.select("fp", "label", "links")
        if step.where("moved").isEmpty():
            return labels.drop("links")


def _fits(a: str, b: str) -> str:
    """SQL: two numbers of shingles that allow the similarity at all."""
    return f"least({a}, {b}) >= {SIMILARITY} * greatest({a}, {b})"


def ranks(texts: DataFrame, sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted elements that two texts or more of a sample of texts (fp) have, and how many have each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e, n = np.unique(np.concatenate([np.unique(np.frombuffer(s, "<u4")) for s in b["s"]] or [np.zeros(0, "<u4")]), return_counts=True)
            yield pd.DataFrame({"e": e.astype(np.int64), "n": n.astype(np.int64)})

    some = sets.join(common.sample(texts, "fp", RANKED_TEXTS, 11), "fp", "left_semi").select("s")
    found = some.mapInPandas(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where("n > 1")
    found = found.orderBy(F.desc("n"), "e").limit(RANKED).toPandas().sort_values("e")  # bounded by RANKED
    return found["e"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefix(s: bytes, known: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The first elements of a text, rare ones first: any text similar to it has one of them among its own; and the number of all."""
    x = np.unique(np.frombuffer(s, "<u4")).astype(np.int64)
    n = np.zeros(len(x), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        n = np.where(known[at] == x, seen[at], 0)
    size = len(s) // 4
    return x[np.lexsort((x, n))][: size - math.ceil(SIMILARITY * size - 1e-9) + 1], len(x)


def left_over(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts (fp, label, size) of different labels that may be similar, by prefix filter."""
    known, seen = ranks(open_.select("fp"), sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [prefix(s, known, seen) for s in b["s"]]
            n = [len(x) for x, _ in got]
            out = b[["fp", "label", "size"]].loc[b.index.repeat(n)]
            out["e"] = np.concatenate([x for x, _ in got] or [np.zeros(0, np.int64)])
            out["rest"] = np.concatenate([total - np.arange(len(x)) for x, total in got] or [np.zeros(0, np.int64)])
            yield out

    p = open_.join(sets, "fp").select("fp", "label", "size", "s").mapInPandas(run, "fp long, label long, size long, e long, rest long")
    p = common.cut(p, "prefixes")
    met = p.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("e")
    p = common.cut(p.join(met, "e", "left_semi"), "met")  # elements of one component decide nothing
    x = p.select("e", F.col("fp").alias("a"), F.col("label").alias("la"), F.col("size").alias("na"), F.col("rest").alias("ra"))
    y = p.select("e", F.col("fp").alias("b"), F.col("label").alias("lb"), F.col("size").alias("nb"), F.col("rest").alias("rb"))
    # nothing before the first shared element is shared: what comes from it on must be enough
    enough = f"least(ra, rb) >= {SIMILARITY / (1 + SIMILARITY)} * (na + nb) - 1e-6"
    return x.join(y, "e").where("a < b and la <> lb and " + _fits("na", "nb") + " and " + enough).select("a", "b").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (fp, label) with the components joined that the new links join."""
    near = labels.select(F.col("fp").alias("a"), F.col("label").alias("la"))
    far = labels.select(F.col("fp").alias("b"), F.col("label").alias("lb"))
    joined = links.join(near, "a", "left").join(far, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    moved = components(joined).select(F.col("fp").alias("label"), F.col("label").alias("to"))
    nodes_ = labels.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("fp").agg(F.min("label").alias("label"))
    return common.cut(nodes_.join(moved, "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """(fp, label) of all nodes that are linked with another."""
    spread = common.cut(buckets(docs), "buckets")
    heads = spread.groupBy("h").agg(F.min(F.struct("fp", "size")).alias("head"), F.max("fp").alias("last"), F.count("*").alias("members")).where("head.fp < last")
    heads = common.cut(heads.select("h", F.col("head.fp").alias("head"), F.col("head.size").alias("head_size"), "members"), "heads")
    spread = common.cut(common.skewed_join(spread, heads, ["h"], "members"), "shared")  # members of buckets with two texts or more
    sets = common.cut(shingle_sets(docs, spread.select("fp").distinct()), "sets")
    tested = spread.where("fp <> head and " + _fits("size", "head_size")).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    tested = common.cut(tested, "pairs")
    labels = components(common.cut(verified(tested, sets), "links"))
    used = spread.where("fp = head").select("h", "fp")
    for i in range(ROUNDS + 1):
        state = spread.select("h", "fp", "size").join(labels, "fp", "left").select("h", "fp", "size", F.coalesce("label", "fp").alias("label"))
        state = common.cut(state, "state")
        main = state.groupBy("h").agg(F.min("label").alias("main"), F.max("label").alias("hi"), F.count("*").alias("members")).where("main < hi")
        main = common.cut(main.select("h", "main", "members", F.col("members").alias("n")), "main")
        open_ = common.skewed_join(state, main, ["h"], "n")
        if i == ROUNDS:
            fresh = left_over(common.cut(open_.select("fp", "label", "size").distinct(), "open"), sets)
        else:
            left = open_.where("label <> main").join(used, ["h", "fp"], "left_anti")
            # the first member of each bucket, and a few by their hash, so that no bucket is sorted in one task
            wanted = F.expr(f"least({PIVOTS}, {ROUND_PAIRS} div members)")
            few = left.where(F.pmod(F.xxhash64("fp", F.lit(i)), F.col("members")) < wanted).select("h", "fp", "label", "size")
            first = left.groupBy("h").agg(F.min(F.struct("fp", "label", "size")).alias("m")).select("h", "m.*")
            pivots = few.union(first).distinct()
            pivots = common.cut(pivots.select("h", F.col("fp").alias("p"), F.col("label").alias("pl"), F.col("size").alias("ps")), "pivots")
            if pivots.isEmpty():
                return labels
            used = common.cut(used.union(pivots.select("h", F.col("p").alias("fp"))), "used")
            met = pivots.join(main.select("h", "n"), "h")  # at most PIVOTS + 1 rows a bucket
            fresh = common.skewed_join(open_, met, ["h"], "n").where("label <> pl and " + _fits("size", "ps"))
            fresh = fresh.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()
        fresh = common.cut(fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = common.cut(verified(fresh, sets), "links")
        tested = common.cut(tested.union(fresh), "tested") if i < ROUNDS else tested
        if not links.isEmpty():
            labels = merged(labels, links)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, keep, fp: one row per document; keep marks the one that stands for its class.

    Repeated rows of the one that stands for its class are all marked.
    """
    every = nodes(docs)
    copies = every.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("low"), F.count("*").alias("n"))
    texts = common.cut(copies.join(classes(docs), "fp", "left").select("fp", "first", "low", "n", F.coalesce("label", "fp").alias("label")), "texts")
    best = texts.groupBy("label").agg(F.min("first").alias("class_id"), F.min(F.struct("low", "fp")).alias("best"), F.count("*").alias("m"))
    # classes and copies are joined back in two steps, hot ones spread
    texts = common.skewed_join(texts, common.cut(best, "best"), ["label"], "m")
    texts = common.cut(texts.select("fp", "class_id", "best", "n"), "classed")
    known = common.skewed_join(every.where("fp is not null"), texts, ["fp"], "n")
    keep = (F.coalesce("doc_id", F.lit(LAST)) == F.col("best.low")) & (F.col("fp") == F.col("best.fp"))
    wordless = every.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("keep"), "fp")
    return known.select("doc_id", "class_id", keep.alias("keep"), "fp").unionByName(wordless)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, with their own columns; documents without words stay."""
    verdict = common.cut(near_duplicates(docs), "verdicts")
    gone = verdict.where("not keep").select("doc_id", "fp").distinct()
    twice = verdict.where("keep and fp is not null").groupBy("doc_id", "fp").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "fp")
    d = docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp"))
    same = lambda x: d["doc_id"].eqNullSafe(x["doc_id"]) & (d["fp"] == x["fp"])
    left = d.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():  # repeated rows of a document that stays: one of them
        same = lambda x: left["doc_id"].eqNullSafe(x["doc_id"]) & (left["fp"] == x["fp"])
        left = left.join(twice, same(twice), "left_anti").unionByName(left.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "fp"]))
    return common.unpacked(left, docs)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).drop("fp")
