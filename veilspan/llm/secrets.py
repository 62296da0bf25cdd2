"""Secret scans with SQL functions only: fixed patterns, and Markov models of characters.

Base spans are leftmost non-overlapping matches of three patterns. The method adds long tokens
(runs of 20 or more of `[A-Za-z0-9+/_=-]`) that overlap no base span and that a first-order Markov
model of random strings explains better than one of ordinary identifiers, by the mean
log-likelihood ratio of their transitions. Both models are transition counts, trained from
labelled samples: values that the base patterns found are random, other tokens of the sampled
documents that are made of words or numbers are ordinary. The trained table has 94 x 94 numbers and is a literal of the query.

Offsets are code points, ends exclusive. Nulls: null text is empty and has no spans; a null doc_id
is a value. Spans with one start are ordered by kind, then as found. Overlapping kinds are all reported; redaction
merges them. Repeated rows are scanned alike, empty tables give empty results, and only doc_id and
text are read (redaction also rewrites n_chars where there is one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.spans import running
from veilspan.llm import common

_RUN = "[A-Za-z0-9+/_=-]"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "random"]  # in the order of listing
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
# whole runs of the least length: the same as all runs without the short ones, but short ones cost nothing
ACCESS = f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"
HEX = f"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}"
TOKEN = f"(?<!{_RUN}){_RUN}{{{MIN_TOKEN},}}"
TRAIN_DOCS = 3000  # sampled documents to learn from, at most
TRAIN_TOKEN, TRAIN_RANDOM = 8, 16  # shortest tokens to learn from, ordinary and random
PRIOR_RANDOM, PRIOR_ORDINARY = 20.0, 0.2  # pseudo-counts per transition; random strings are near uniform
ALPHABET = 66
THRESHOLD = 0.5  # mean log-likelihood ratio of a transition, in nats
# words, snake and camel case, capitals and numbers, joined in any way
ORDINARY = "^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+))*$"
MASK = "[SECRET]"
FEW_SPANS = 64  # more are cut out of a text's array of characters
_FIRST, _WIDTH = 33, 94  # printable ASCII

_NONE = "cast(array() as array<struct<start:int,end:int,kind:int,len:int,value:string>>)"


def _found(pattern: str, text: Column, kind: int, gate: Column, group: int = 0) -> Column:
    """array<struct<start,end,kind,len,value>> of all matches; len is that of the group. Texts without a match are read once."""
    p = F.lit(pattern)
    gaps = F.split(text, p, -1)
    group_ = F.regexp_extract_all(text, p, F.lit(group)) if group else None

    def placed(m: Column) -> Column:
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(m)).alias("gap"), m.alias("m"), (m if group_ is None else group_).alias("g"))

        def at(z: Column) -> Column:
            ends = running(F.transform(z, lambda x: F.length(x["gap"]) + F.length(x["m"])), lambda a, x: a + x)
            return F.zip_with(z, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.length(x["g"]).alias("len"), x["m"].alias("value")))

        return F.when(F.size(m) > 0, F.transform(F.array(zipped), at)[0]).otherwise(F.expr(_NONE))

    found = F.transform(F.array(F.regexp_extract_all(text, p, F.lit(0))), placed)[0]
    return F.coalesce(F.when(gate, found), F.expr(_NONE))


_BY_START_AND_KIND = "(a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 else a.kind - b.kind end"


def with_base(docs: DataFrame) -> DataFrame:
    """docs with secret_base: array<struct<start,end,kind,len,value>> ordered by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # plain tests that every text with a match passes
    low = F.lower(text)
    called = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        called = called | low.contains(word)
    base = F.concat(
        F.filter(_found(ASSIGN, text, 0, called, 2), lambda x: x["len"] >= MIN_VALUE), _found(ACCESS, text, 1, text.contains("AKIA")), _found(HEX, text, 2, F.lit(True))
    )
    d = docs.withColumn("secret_base", base)
    return d.withColumn("secret_base", F.expr(f"array_sort(secret_base, {_BY_START_AND_KIND})"))


def train(docs: DataFrame, sample_docs: int = TRAIN_DOCS) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary, learnt from at most sample_docs documents."""
    text = F.coalesce("text", F.lit(""))
    pick = common.sample(docs.select("doc_id", text.alias("text")), "doc_id", sample_docs, 5).select("text")
    values = [F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
              F.regexp_extract_all("text", F.lit(HEX), F.lit(0))]
    bare = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = F.regexp_extract_all(bare, F.lit(f"{_RUN}{{{TRAIN_TOKEN},}}"), F.lit(0))
    labelled = pick.select(F.explode(F.concat(
        F.transform(F.concat(*values), lambda t: F.struct(F.lit(1).alias("y"), t.alias("t"))),
        F.transform(ordinary, lambda t: F.struct(F.lit(0).alias("y"), t.alias("t"))),
    )).alias("e")).select("e.y", "e.t").where(
        f"t rlike '^[!-~]+$' and if(y = 1, length(t) >= {TRAIN_RANDOM}, length(t) >= {TRAIN_TOKEN} and t rlike '{ORDINARY}')")
    pairs = labelled.select("y", F.explode(F.expr("transform(sequence(1, length(t) - 1), i -> substring(t, i, 2))")).alias("p"))
    count = {(r["y"], r["p"]): r["n"] for r in pairs.groupBy("y", "p").agg(F.count("*").alias("n")).collect()}
    row: dict[tuple[int, str], int] = {}
    for (y, p), n in count.items():
        row[y, p[0]] = row.get((y, p[0]), 0) + n

    def log_p(y: int, a: str, b: str, prior: float) -> float:
        return math.log((count.get((y, a + b), 0) + prior) / (row.get((y, a), 0) + prior * ALPHABET))

    symbols = [chr(_FIRST + i) for i in range(_WIDTH)]
    return [log_p(1, a, b, PRIOR_RANDOM) - log_p(0, a, b, PRIOR_ORDINARY) for a in symbols for b in symbols]


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with secret_base and secret_spans (base and method spans, by start and kind)."""
    table = train(docs) if table is None else table
    literal = ",".join(f"{x:.6f}" for x in table)
    d = with_base(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    d = d.withColumn("secret_tokens", _found(TOKEN, text, 3, F.lit(True)))
    # a token's code points once, the transitions from the two shifted arrays, and their sum
    codes = f"transform(split(x.value, ''), c -> ascii(c) - {_FIRST})"
    steps = f"transform(array({codes}), c -> zip_with(slice(c, 1, x.len - 1), slice(c, 2, x.len - 1), (a, b) -> a * {_WIDTH} + b))[0]"
    score = f"aggregate({steps}, 0D, (a, k) -> a + cast(split('{literal}', ',') as array<double>)[k]) / (x.len - 1)"
    # tokens do not overlap each other: what overlaps one is a base span that began before, or the next span
    d = d.withColumn("secret_all", F.expr(f"array_sort(concat(secret_base, secret_tokens), {_BY_START_AND_KIND})"))
    d = d.withColumn("secret_reach", running(F.expr("transform(secret_all, x -> if(x.kind < 3, x.end, 0))"), F.greatest))
    # both arrays are bound once; an array that a lambda names could be made anew for each element
    clear = "z.r[i] <= x.start and coalesce(get(z.a, i + 1).start >= x.end, true)"
    kept = f"filter(z.a, (x, i) -> x.kind < 3 or (if({clear}, {score}, 0) > {threshold}))"
    d = d.withColumn("secret_spans", F.expr(f"transform(array(struct(secret_all as a, secret_reach as r)), z -> {kept})[0]"))
    return d.drop("secret_tokens", "secret_all", "secret_reach")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.start, x.end)), ',')")


def redact(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """docs with every secret span replaced by MASK, and n_chars counted anew."""
    d = scan(docs.select("doc_id", "text", common.packed(docs)), table)
    few = f"""aggregate(secret_spans, struct('' as out, 0 as at), (a, x) -> struct(
        if(x.start >= a.at, concat(a.out, substring(text, a.at + 1, x.start - a.at), '{MASK}'), a.out) as out, greatest(a.at, x.end) as at),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    # where there are many, the text's characters are counted off once: heads are the spans that begin after all before them
    d = d.withColumn("secret_reach", running(F.expr("transform(secret_spans, x -> x.end)"), F.greatest))
    d = d.withColumn("secret_heads", F.expr("filter(transform(secret_spans, (x, i) -> if(i = 0 or x.start >= secret_reach[i - 1], i, -1)), i -> i >= 0)"))
    many = f"""transform(array(split(text, '')), c -> concat(array_join(transform(secret_heads, (h, k) -> transform(array(if(h = 0, 0, secret_reach[h - 1])), at ->
        concat(array_join(slice(c, at + 1, secret_spans[h].start - at), ''), '{MASK}'))[0]), ''), array_join(slice(c, element_at(secret_reach, -1) + 1, size(c)), '')))[0]"""
    masked = F.expr(f"case when size(secret_spans) = 0 then text when size(secret_spans) <= {FEW_SPANS} then {few} else {many} end")
    d = d.withColumn("text", masked)
    n_chars = F.when(F.size("secret_spans") > 0, F.length("text")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))
    return common.unpacked(d, docs, text=F.col("text"), n_chars=n_chars)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(secret_base, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return d.select("doc_id", *n, F.sha2(_joined("secret_base"), 256).alias("base_sha256"), _joined("secret_spans").alias("spans"))
