"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source, in the order of the md5 of their doc_id, form blocks of `block_docs` rows. Weights
are exact fractions, scaled to whole units; H is the sum of the units of all sources. Block j of a
source with u units is released at slot floor(j*H/u) and has the deadline ceil((j+1)*H/u).
Sources of one weight form a class, whose n*u units are scheduled as one: each slot takes, among
the class blocks released, the one with the earliest deadline (ties: shorter window overlap first
as in PD2, then the smaller weight), and the sources of a class take its blocks in turn. A block of
the k-th of n sources has its class block's window, which lies inside its own, so that every
release and deadline is met and no source is ever a whole block away from its exact target. The
schedule repeats every H slots, so only one period is worked out, in a fold over H slots with one
state per class; everything else is joins on small keys.

Rows are numbered within a source by md5 prefix: counts per (source, prefix) are added up in a
small table, and only rows of one (source, prefix) are sorted together, so that a hot source is
dealt over all tasks. When a source runs out, its slots fall away and the rest keep their order.

Nulls: a null source is the source '' with the default weight, a null doc_id sorts first. Sources
without a target weight have the default weight each. Rows with one doc_id are ordered by text;
fully equal rows are interchangeable. A source with weight 0 comes after all others. An empty
table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm import common

WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 1.5, "src3": 0.5}  # all other sources weigh DEFAULT
DEFAULT = 1.0
BLOCK_DOCS = 4
PREFIX = 3  # hex digits of md5 that split a source's numbering: 16**PREFIX sorts of even size
FOLD = 256  # slots of one inner fold


def whole_units(weights: dict[str, float], default: float) -> tuple[dict[str, int], int]:
    """The weights as whole numbers without a common divisor."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    base = Fraction(str(default))
    scale = math.lcm(base.denominator, *(f.denominator for f in exact.values()))
    units, rest = {k: int(f * scale) for k, f in exact.items()}, int(base * scale)
    divisor = math.gcd(rest, *units.values()) or 1
    return {k: u // divisor for k, u in units.items()}, rest // divisor


def classes(sources: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """(mix_source, mix_units, mix_turn, mix_members): whole units, and the source's place among the sources of its class."""
    units, rest = whole_units(weights, default)
    known = F.create_map(*[F.lit(x) for k, u in units.items() for x in (k, u)]) if units else None
    own = F.lit(rest) if known is None else F.coalesce(F.try_element_at(known, F.col("mix_source")), F.lit(rest))
    s = sources.select("mix_source", own.cast("long").alias("mix_units"))
    one = Window.partitionBy("mix_units")  # one row per source
    return s.select("mix_source", "mix_units", (F.row_number().over(one.orderBy("mix_source")) - 1).cast("long").alias("mix_turn"), F.count("*").over(one).alias("mix_members"))


def schedule(sources: DataFrame) -> DataFrame:
    """(mix_units, mix_index, mix_at, mix_class, mix_period): the slots of one period by class, by earliest deadline first."""
    s = sources.where("mix_units > 0").groupBy("mix_units").agg((F.count("*") * F.col("mix_units")).alias("total"))
    one = s.groupBy().agg(F.array_sort(F.collect_list(F.struct("mix_units", "total"))).alias("s"), F.sum("total").alias("h")).where("h > 0")  # one entry per weight
    # state: blocks given so far per class, and the classes picked so far
    pick = """transform(array(array_min(filter(transform(s, (x, i) -> struct(
            if(a.done[i] < x.total and floor(a.done[i] * h / x.total) <= t, 0, 1) as wait,
            ceil((a.done[i] + 1) * h / x.total) as deadline,
            if((a.done[i] + 1) * h % x.total = 0, 1, 0) as loose,
            i as i)), c -> c.wait = 0)).i),
          p -> struct(transform(a.done, (d, i) -> if(i = p, d + 1L, d)) as done, array_append(a.picked, p) as picked))[0]"""
    inner = f"aggregate(sequence(b * {FOLD}, least((b + 1) * {FOLD}, cast(h as int)) - 1), struct(o.done as done, cast(array() as array<int>) as picked), (a, t) -> {pick})"
    step = f"""flatten(aggregate(sequence(0, cast((h - 1) div {FOLD} as int)), struct(transform(s, x -> 0L) as done, cast(array() as array<array<int>>) as picked),
        (o, b) -> transform(array({inner}), r -> struct(r.done as done, array_append(o.picked, r.picked) as picked))[0]).picked)"""
    slots = one.select("s", "h", F.posexplode(F.expr(step)).alias("mix_at", "p"))
    slots = slots.select(F.expr("s[p].mix_units").alias("mix_units"), F.expr("s[p].total").alias("mix_class"), F.col("mix_at").cast("long").alias("mix_at"), F.col("h").alias("mix_period"))
    index = F.row_number().over(Window.partitionBy("mix_units").orderBy("mix_at")) - 1
    return slots.withColumn("mix_index", index.cast("long"))


def _key(docs: DataFrame) -> tuple[Column, Column]:
    source = F.coalesce(docs["source"].cast("string"), F.lit(""))
    return source, F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))


def numbered(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """docs with mix_source, and mix_n: the row's number within its source from 0."""
    source, key = _key(docs)
    d = docs.withColumns({"mix_source": source, "mix_key": key})
    d = d.withColumn("mix_prefix", F.substring("mix_key", 1, prefix))
    counts = d.groupBy("mix_source", "mix_prefix").agg(F.count("*").alias("c"))
    before = Window.partitionBy("mix_source").orderBy("mix_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "mix_prefix", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("mix_before"))
    within = Window.partitionBy("mix_source", "mix_prefix").orderBy("mix_key", F.xxhash64("text"))
    d = d.withColumn("mix_row", F.row_number().over(within))
    d = d.join(offsets, ["mix_source", "mix_prefix"])
    return d.withColumn("mix_n", F.col("mix_before") + F.col("mix_row") - 1).drop("mix_row", "mix_before", "mix_prefix", "mix_key")


def positions(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with mix_source, mix_n, mix_block, mix_slot (of the block; null for weight 0), mix_release and mix_deadline.

    docs has doc_id, source and text (or a hash of it); its other columns must not begin with mix_.
    """
    d = numbered(docs).withColumn("mix_block", F.expr(f"mix_n div {block_docs}"))
    sources = classes(docs.select(_key(docs)[0].alias("mix_source")).distinct(), WEIGHTS if weights is None else weights, default)
    plan = schedule(sources)
    d = d.join(sources, "mix_source").withColumn("mix_own", F.expr("mix_block * mix_members + mix_turn"))  # the block's number in its class
    heads = plan.select("mix_units", "mix_class", "mix_period").distinct()
    d = d.join(heads, "mix_units", "left").withColumn("mix_index", F.expr("mix_own % mix_class"))
    d = d.join(plan.select("mix_units", "mix_index", "mix_at"), ["mix_units", "mix_index"], "left")
    return d.withColumns({
        "mix_slot": F.expr("(mix_own div mix_class) * mix_period + mix_at"),
        "mix_release": F.expr("if(mix_period is null, null, mix_block * mix_period div mix_units)"),
        "mix_deadline": F.expr("if(mix_period is null, null, ((mix_block + 1) * mix_period + mix_units - 1) div mix_units)"),
    }).drop("mix_at", "mix_index", "mix_units", "mix_period", "mix_own", "mix_class", "mix_turn", "mix_members")


def interleave(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs with their own columns, written out in the order of the mix."""
    p = positions(docs.select("doc_id", "source", F.xxhash64("text").alias("text"), common.packed(docs)), **options)
    p = p.orderBy(F.coalesce("mix_slot", F.lit(2**62)), "mix_source", "mix_n")
    return common.unpacked(p, docs)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(common.read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text")))
    return p.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_n").alias("n_in_source"), F.col("mix_block").alias("block"),
                    F.col("mix_slot").alias("slot"), F.col("mix_release").alias("release"), F.col("mix_deadline").alias("deadline"))
