"""Merkle manifest of a dataset: one tree per language, one over their roots, and a proof for each row.

A digest is a lowercase hex SHA-256. Leaves are ranked by a range sort, so a rank costs one shuffle;
trees are built in blocks of 1,024 consecutive nodes, ten levels at a time. Proofs come from pointer
jumping: every node holds the siblings on its way towards an ancestor; each self-join of that table
doubles the distance and appends the ancestor's segment, until the leaves hold all siblings up to
their root. Only nodes of every 2nd, 4th, 8th ... level are needed after 1, 2, 3 ... rounds.

Defined results: null columns and texts count as `-` in the leaf; a null doc_id comes first in its
tree and is never tampered with; rows with one doc_id ascend by their leaf digest, and equal rows are
leaves of their own; an empty table has no rows and no root; further columns are not read. Texts of
any length are hashed where they are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10  # levels built at once, so 1,024 nodes of a block
FEW_NODES, FEW_DIGESTS = 50_000, 500_000  # most ancestors that a round broadcasts, and digests in their segments; both are known from the level
FEW_TREES = 10_000
TAMPERED = 7
_NODE = "struct<left:boolean,digest:binary>"


def field(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with `idx`, the number of the row within its `tree` by the keys, and the tree's size `n`.

    A range sort is written out with each row's place in its partition; what stands before a
    partition is a sum over at most one row per partition and tree.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = rows.repartitionByRange(parts, "tree", *keys).sortWithinPartitions("tree", *keys)
    s = s.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    s = common.cut(s, name)
    counts = s.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    over = Window.partitionBy("tree")
    counts = counts.select(
        "tree", "part", (F.coalesce(F.sum("c").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(over).alias("n")
    )
    counts = common.cut(counts, f"{name}-counts")  # one row per tree and partition
    few = F.broadcast(counts) if counts.count() <= FEW_NODES else counts
    return s.join(few, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def height(n: Column) -> Column:
    """Levels above n leaves: the smallest h with 2^h >= n."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 2))).cast("int")


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes of BLOCK_LEVELS levels from base on, and the node on top of each block (top true).

    nodes: (tree, idx, height, digest, id, changed), the last two of leaves only; the result has level,
    sibling, left (the sibling stands on the left) and top too.
    """
    columns = ["tree", "level", "idx", "height", "digest", "sibling", "left", "id", "changed", "top"]
    out = "tree string, level int, idx long, height int, digest binary, sibling binary, left boolean, id string, changed binary, top boolean"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        tree, top, first = pdf["tree"].iloc[0], int(pdf["height"].iloc[0]), int(pdf["idx"].iloc[0])
        level, own, frames, rows = base, list(pdf["digest"]), [], list(zip(pdf["id"], pdf["changed"], strict=True))
        while level < min(top, base + BLOCK_LEVELS):
            n = len(own)
            twin = [own[i ^ 1] if i ^ 1 < n else None for i in range(n)]
            frames.append((level, first, own, twin, [bool(i & 1) for i in range(n)], rows, False))
            own = [hashlib.sha256((own[i].hex() + (own[i + 1].hex() if i + 1 < n else "")).encode()).digest() for i in range(0, n, 2)]
            level, first, rows = level + 1, first >> 1, [(None, None)] * len(own)
        frames.append((level, first, own, [None] * len(own), [None] * len(own), rows, True))
        made = [(tree, lv, at + i, top, d, t, s, *r, end) for lv, at, ds, ts, ss, rs, end in frames for i, (d, t, s, r) in enumerate(zip(ds, ts, ss, rs, strict=True))]
        return pd.DataFrame(made, columns=columns)

    keyed = nodes.withColumn("block", F.shiftright("idx", BLOCK_LEVELS))
    return keyed.groupBy("tree", "block").applyInPandas(lambda pdf: build(pdf), out)


def forest(leaves: DataFrame, highest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (tree, level, idx, height, digest, id, changed, seg: the sibling on the way to the parent) and the roots (tree, digest) of all trees.

    leaves: (tree, idx, n, digest, id, changed); highest: the largest height of a tree.
    """
    below, kept, roots, base = leaves.select("tree", "idx", height(F.col("n")).alias("height"), "digest", "id", "changed"), None, None, 0
    while True:
        made = common.cut(_blocks(below, base), f"{name}-level-{base}")
        done = F.col("top") & (F.col("level") == F.col("height"))
        nodes, own = made.where(~F.col("top") | (done & (F.col("level") == 0))), made.where(done).select("tree", "digest")
        kept, roots = (nodes, own) if kept is None else (kept.unionByName(nodes), roots.unionByName(own))
        base += BLOCK_LEVELS
        if base >= highest:
            break
        # the block's place among those of its level is the place of its top node
        below = made.where(F.col("top") & (F.col("level") < F.col("height"))).select("tree", "idx", "height", "digest", "id", "changed")
    step = F.when(F.col("level") < F.col("height"), F.array(F.struct(F.col("left"), F.col("sibling").alias("digest")))).otherwise(F.array())
    return kept.select("tree", "level", "idx", "height", "digest", "id", "changed", step.cast(f"array<{_NODE}>").alias("seg")), roots


def jump(nodes: DataFrame, highest: int, leaves: int, trees: int, name: str) -> DataFrame:
    """The leaves (tree, idx, digest, id, changed, seg) with all siblings up to their root, by rounds of pointer jumping."""
    reach, r = 1, 0
    while reach < highest:
        level = F.col("level")
        near, far = nodes.where(level % (2 * reach) == 0), nodes.where(level % (2 * reach) == reach)
        far = far.select("tree", (level - reach).alias("level"), F.col("idx").alias("up"), F.col("seg").alias("on"))
        many = 2 * leaves / 2**reach + trees * (highest / (2 * reach) + 1)  # levels reach, 3 reach ...
        far = F.broadcast(far) if many <= FEW_NODES and many * reach <= FEW_DIGESTS else far
        # an ancestor has at most 2^reach nodes below it, few of all: where that is not so, there are few ancestors
        near = near.withColumn("up", F.expr(f"shiftright(idx, {min(reach, 62)})")).join(far, ["tree", "level", "up"], "left")
        nodes = near.select("tree", "level", "idx", "height", "digest", "id", "changed", F.when(F.col("on").isNull(), F.col("seg")).otherwise(F.concat("seg", "on")).alias("seg"))
        reach, r = 2 * reach, r + 1
        if reach < highest:
            nodes = common.cut(nodes, f"{name}-jump-{r}")
    return nodes.where("level = 0").select("tree", "idx", "digest", "id", "changed", "seg")


def proofs(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Leaves (tree, idx, n, digest, id, changed) with seg, all siblings up to the root; the roots (tree, digest); the number of trees."""
    facts = leaves.groupBy("tree").agg(F.max("n").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    widest, total, trees = facts[0] or 1, facts[1] or 0, facts[2]
    highest = (widest - 1).bit_length()
    nodes, roots = forest(leaves, highest, name)
    return jump(nodes, highest, total, trees, name), roots, trees


def _fold(start: Column, seg: Column) -> Column:
    def step(a: Column, x: Column) -> Column:
        d = F.coalesce(F.lower(F.hex(x["digest"])), F.lit(""))
        return F.sha2(F.when(x["left"], F.concat(d, a)).otherwise(F.concat(a, d)).cast("binary"), 256)

    return F.aggregate(seg, start, step)


def manifest(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of documents.

    proof: array<struct<left,digest>>, null digests where a level has no sibling. folded_root is
    computed from the row's leaf as it is after tampering, and the original siblings.
    """
    own = {f: F.col(f"`{f}`") for f in FIELDS}
    hit = F.coalesce(F.crc32(own["doc_id"].cast("string").cast("binary")) % tampered == 0, F.lit(False)) & own["n_chars"].isNotNull()
    changed = F.when(hit, leaf([own["n_chars"] + 1 if f == "n_chars" else own[f] for f in FIELDS]))
    d = docs.select(
        own["doc_id"].alias("doc_id"), F.coalesce(F.concat(F.lit("="), own["lang"].cast("string")), F.lit("")).alias("tree"),
        F.unhex(leaf(list(own.values()))).alias("digest"), F.unhex(changed).alias("changed"),
    )
    d = common.cut(d, "merkle-leaves")  # texts are read and hashed once
    d = ranked(d, ["doc_id", "digest"], "merkle-ranked")
    low, subroots, trees = proofs(d.select("tree", "idx", "n", "digest", F.col("doc_id").cast("string").alias("id"), "changed"), "merkle")
    top = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.lit(None).cast("binary").alias("changed")), ["id"], "merkle-top")
    up, roots, _ = proofs(top, "merkle-langs")
    root = (roots.first() or {"digest": b""})["digest"]  # one row, or none of an empty table
    in_tree = d.groupBy("tree").agg(F.count("*").alias("in_tree"))
    up = common.cut(up.select(F.col("id").alias("tree"), F.col("digest").alias("subroot"), F.col("seg").alias("top_seg")).join(in_tree, "tree"), "merkle-up")
    p = low.join(F.broadcast(up.drop("in_tree")), "tree") if trees <= FEW_TREES else common.skewed_join(low, up, ["tree"], "in_tree")
    p = p.withColumn("seg", F.concat("seg", "top_seg"))
    text = lambda c: F.lower(F.hex(c))
    p = p.select(
        F.col("id").cast("long").alias("doc_id"), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang"), text("digest").alias("leaf"),
        text("subroot").alias("subroot"), F.lit(bytes(root).hex()).alias("root"), F.col("seg").alias("proof"),
        F.sha2(F.array_join(F.transform("seg", lambda x: text(x["digest"])), "").cast("binary"), 256).alias("proof_sha256"),
        _fold(text(F.coalesce("changed", "digest")), F.col("seg")).alias("folded_root"),
    )
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.read(spark, sf_dir, "documents")).drop("lang", "proof")
