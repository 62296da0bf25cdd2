"""A token classifier: a linear chain whose weights are a table.

A word's features meet their weights in a join, which adds up to one score per label (emissions);
the best labels of a sentence are a Viterbi fold over the arrays in its row. Training begins with
smoothed log-odds of counts and goes on with an averaged structured perceptron, one job per epoch
over at most TRAIN_SENTENCES sentences. Labels are BIO; I- never follows what it cannot continue.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import find
from veilspan.sources.shared import cut

WORD = r"\p{L}[\p{L}\p{M}'’-]*|\p{N}+|[^\s\p{L}\p{N}]"
TRAIN_SENTENCES = 20_000  # most sentences to learn from: the first by a hash of their ids
EPOCHS, RATE, SMOOTHING = 6, 0.5, 0.5
FEW_FEATURES = 200_000  # most rows of weights that a join broadcasts
NEVER = -1e9


@dataclass
class Model:
    """weights: (feature, s: array of a score per label); steps: scores of a label after another, -1 for the beginning."""

    labels: list[str]
    weights: DataFrame
    steps: dict[tuple[int, int], float]


def words(text: str = "text") -> Column:
    """array<struct<start,end,value,grp>> of the words, numbers and signs of a text."""
    return find(F.col(text), WORD)


def shape(w: Column) -> Column:
    """Capitals X, small letters x, digits 9, anything else as it is; repeats once."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\p{N}+", "9")
    return F.substring(kinds, 1, 6)


def features(tokens: str = "tokens") -> Column:
    """array<array<string>>: what is known of each word: itself, its ends, its shape and its neighbours."""
    t = F.col(tokens)

    def of(x: Column, i: Column) -> Column:
        before, after = F.get(t, i - 1)["value"], F.get(t, i + 1)["value"]
        side = lambda name, w: F.concat(F.lit(name), F.coalesce(F.lower(w), F.lit("\n")))
        w = x["value"]
        return F.array(
            F.lit("bias"), F.concat(F.lit("w="), F.lower(w)), F.concat(F.lit("p="), F.lower(F.substring(w, 1, 3))), F.concat(F.lit("s="), F.lower(F.right(w, F.lit(3)))),
            F.concat(F.lit("h="), shape(w)), side("b=", before), side("a=", after), F.concat(F.lit("bh="), F.coalesce(shape(before), F.lit("\n")), F.lit("/"), shape(w)),
            F.concat(F.lit("ah="), shape(w), F.lit("/"), F.coalesce(shape(after), F.lit("\n"))),
        )

    return F.transform(t, of)


def gold_labels(tokens: str = "tokens", entities: str = "entities") -> Column:
    """array<string>: the BIO label of each word by the entities (start, end, category) of its sentence."""
    inside = f"filter({entities}, e -> e.start < x.end and x.start < e.end)"
    return F.expr(f"transform({tokens}, (x, i) -> transform(array(get({inside}, 0)), e -> case when e is null then 'O' when i > 0 and {tokens}[i - 1].end > e.start then concat('I-', e.category) else concat('B-', e.category) end)[0])")


def _allowed(before: str | None, label: str) -> bool:
    return not label.startswith("I-") or (before is not None and before != "O" and before[2:] == label[2:])


def viterbi(emissions: Column, labels: list[str], steps: dict[tuple[int, int], float]) -> Column:
    """array<int>: the labels of the best path through emissions (array<array<double>>); ties go to the smaller label."""
    n = len(labels)
    score = lambda a, b: steps.get((a, b), 0.0) if _allowed(labels[a] if a >= 0 else None, labels[b]) else NEVER
    table = F.array(*[F.array(*[F.lit(score(a, b)) for a in range(n)]) for b in range(n)])  # by the later label
    begin = F.array(*[F.lit(score(-1, b)) for b in range(n)])

    def step(a: Column, e: Column) -> Column:
        ways = F.transform(table, lambda row: F.array_max(F.transform(a["score"], lambda s, k: F.struct((s + F.get(row, k)).alias("v"), (-k).alias("k")))))
        follow = lambda w: F.struct(F.zip_with(w, e, lambda x, y: x["v"] + y).alias("score"), F.array_append(a["back"], F.transform(w, lambda x: -x["k"])).alias("back"))
        opened = F.struct(F.zip_with(begin, e, lambda x, y: x + y).alias("score"), a["back"].alias("back"))
        return F.when(F.size(a["score"]) == 0, opened).otherwise(F.transform(F.array(ways), follow)[0])

    def trace(a: Column) -> Column:
        last = -F.array_max(F.transform(a["score"], lambda s, k: F.struct(s.alias("v"), (-k).alias("k"))))["k"]
        path = F.aggregate(F.reverse(a["back"]), F.array(last), lambda p, row: F.array_append(p, F.get(row, F.get(p, F.size(p) - 1))))
        return F.when(F.size(a["score"]) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.reverse(path))

    seed = F.expr("struct(cast(array() as array<double>) as score, cast(array() as array<array<int>>) as back)")
    return F.aggregate(emissions, seed, step, trace)


def emissions(sentences: DataFrame, weights: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, e: array<array<double>>) of sentences (doc_id, tokens): the summed weights of each word's features."""
    f = sentences.select("doc_id", F.posexplode(features()).alias("i", "f")).select("doc_id", "i", F.explode("f").alias("feature"))
    small = F.broadcast(weights) if weights.count() <= FEW_FEATURES else weights
    sums = [F.sum(F.coalesce(F.col("s")[k], F.lit(0.0))).alias(f"s{k}") for k in range(len(labels))]
    e = f.join(small, "feature", "left").groupBy("doc_id", "i").agg(*sums)
    one = F.struct("i", F.array(*[f"s{k}" for k in range(len(labels))]).alias("s"))
    return e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("e"))


def _decoded(sentences: DataFrame, m: Model) -> DataFrame:
    """sentences (doc_id, tokens and others) with e and path (label numbers)."""
    e = emissions(sentences, m.weights, m.labels)
    return sentences.join(e, "doc_id").withColumn("path", viterbi(F.col("e"), m.labels, m.steps))


def _counts(s: DataFrame, path: str, by: int = 1) -> tuple[DataFrame, DataFrame]:
    """(feature, label, n) and (a, b, n): how often features and steps go with the labels of a path."""
    x = s.select(F.posexplode(features()).alias("i", "f"), path).select(F.explode("f").alias("feature"), F.expr(f"{path}[i]").alias("label"))
    steps = s.select(F.posexplode(path).alias("i", "b"), path).select(F.expr(f"if(i = 0, -1, {path}[i - 1])").alias("a"), "b")
    count = F.count("*") * by
    return x.groupBy("feature", "label").agg(count.alias("n")), steps.groupBy("a", "b").agg(count.alias("n"))


def _table(long: DataFrame, labels: list[str]) -> DataFrame:
    """(feature, s) of (feature, label, w)."""
    return long.groupBy("feature").agg(F.array(*[F.sum(F.when(F.col("label") == k, F.col("w")).otherwise(0.0)) for k in range(len(labels))]).alias("s"))


def train(sentences: DataFrame, epochs: int = EPOCHS, most: int = TRAIN_SENTENCES) -> Model:
    """A model of sentences (doc_id, text, entities: array<struct<start,end,category>>)."""
    s = sentences.select("doc_id", "text", "entities").orderBy(F.xxhash64("doc_id")).limit(most).withColumn("tokens", words()).where("size(tokens) > 0")
    s = s.withColumn("gold_names", gold_labels())
    names = sorted({r["l"] for r in s.select(F.explode("gold_names").alias("l")).distinct().collect()} | {"O"})  # two a category
    names = sorted(set(names) | {"B-" + x[2:] for x in names if x != "O"} | {"I-" + x[2:] for x in names if x != "O"})
    number = F.create_map(*[F.lit(x) for k, v in enumerate(names) for x in (v, k)])
    s = cut(s.select("doc_id", "tokens", F.transform("gold_names", lambda x: number[x]).alias("gold")), "tagger-sentences")
    emitted, followed = _counts(s, "gold")
    total = emitted.groupBy("feature").agg(F.sum("n").alias("t"))
    size = len(names)
    # log of a label's share among the feature's words, divided by the number of features of a word
    every = total.crossJoin(sentences.sparkSession.range(size).select(F.col("id").cast("int").alias("label")))  # a few labels
    odds = every.join(emitted, ["feature", "label"], "left").select("feature", "label", (F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.col("t") + SMOOTHING * size)) / 9).alias("w"))
    long = cut(odds, "tagger-weights")
    first = {(r["a"], r["b"]): r["n"] for r in followed.collect()}  # labels times labels
    of = {a: sum(n for (x, _), n in first.items() if x == a) for a in range(-1, size)}
    steps = {(a, b): math.log((first.get((a, b), 0) + SMOOTHING) / (of[a] + SMOOTHING * size)) for a in range(-1, size) for b in range(size)}
    sums, step_sums = long, dict(steps)
    for epoch in range(1, epochs):
        got = cut(_decoded(s, Model(names, _table(long, names), steps)).where("path <> gold").select("tokens", "gold", "path"), "tagger-errors")
        if got.isEmpty():
            break
        plus, minus = _counts(got, "gold"), _counts(got, "path", -1)
        delta = plus[0].unionByName(minus[0]).groupBy("feature", "label").agg(F.sum("n").alias("d")).join(total, "feature")
        delta = delta.select("feature", "label", (RATE * F.col("d") / F.sqrt("t")).alias("w"))
        long = cut(long.unionByName(delta).groupBy("feature", "label").agg(F.sum("w").alias("w")), "tagger-weights")
        sums = cut(sums.unionByName(long).groupBy("feature", "label").agg(F.sum("w").alias("w")), "tagger-sums")
        moved = {(r["a"], r["b"]): r["n"] for r in plus[1].unionByName(minus[1]).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
        steps = {k: v + RATE * moved.get(k, 0) / math.sqrt(1 + of[k[0]]) for k, v in steps.items()}
        step_sums = {k: step_sums[k] + v for k, v in steps.items()}
    else:
        epoch = epochs
    rounds = max(1, epoch)
    return Model(names, cut(_table(sums.withColumn("w", F.col("w") / rounds), names), "tagger-model"), {k: v / rounds for k, v in step_sums.items()})


def tag(docs: DataFrame, m: Model) -> DataFrame:
    """Word labels (doc_id, chunk, word, start, end, label, score) of texts (doc_id, text), as the other operators of the model stage take them.

    score: the label's share among the word's emissions.
    """
    s = docs.select("doc_id", "text").where("text is not null").withColumn("tokens", words()).where("size(tokens) > 0").select("doc_id", "tokens")
    d = _decoded(s, m)
    names = F.array(*map(F.lit, m.labels))
    share = lambda e, k: 1 / F.aggregate(e, F.lit(0.0), lambda a, x: a + F.exp(F.least(x - F.get(e, k), F.lit(50.0))))
    rows = F.zip_with(F.arrays_zip(F.col("tokens").alias("t"), F.col("path").alias("k")), F.col("e"), lambda x, e: F.struct(
        x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), F.get(names, x["k"]).alias("label"), share(e, x["k"]).alias("score")))
    return d.select("doc_id", F.lit(0).alias("chunk"), F.posexplode(rows).alias("word", "r")).select("doc_id", "chunk", "word", "r.*")
