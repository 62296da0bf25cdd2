"""Quality rules: per-document counts, then cross-document line frequency.

Lines are lower-cased and their whitespace runs made one space; their hashes are counted over the
distinct documents of a host (the `source` column; null is a host of its own). Documents of a host
with equal texts are one document, so that a text is not rejected for having been copied verbatim
(`count="ids"` counts them by doc_id instead); texts that differ anywhere are different documents,
near copies too. A line in more than
LINE_DOCS documents of its host and in more than LINE_SHARE of them is above the limit and is
removed; a document with less than DEPLETED of its words left is rejected.

Nulls: null text is an empty text (rejected, under 50 words). Null doc_id and source are values.
Repeated rows each get their verdict. Ties cannot occur. An empty table gives an empty result.
Columns other than doc_id, text and source are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

MIN_WORDS = 50  # fewer fail
MAX_REPEAT_PERCENT = 50  # a larger share of words in repeated 3-word windows fails
LINE_DOCS = 20  # a line in more distinct documents of its host than this ...
LINE_SHARE = 0.01  # ... and than this share of them is above the limit
DEPLETED = 0.2  # a smaller share of words left means rejection

SCHEMA = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, lines array<struct<h:long,n:int>>"
)


def repeat_words(ws: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(ws)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int64, n)
    if len(seen) == n:
        return 0
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, inv, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[inv] > 1
    cover = np.zeros(n, bool)
    for i in range(3):
        cover[i : n - 2 + i] |= hit
    return int(cover.sum())


def line_hash(line: str) -> int:
    norm = b" ".join(common.words(line.lower()))
    return zlib.crc32(norm) << 31 ^ zlib.crc32(norm[::-1], 7)


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of one text."""
    text = text or ""
    ws = common.words(text)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    lines, dup = [], 0
    for line in text.split("\n"):
        own = common.words(line)
        if not own:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        lines.append((line_hash(line), len(own)))
    return len(ws), len(text) - spaces, symbols, dup, repeat_words(ws), lines


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [measure(t) for t in b["text"]]
        out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])
        out["lines"] = [[{"h": h, "n": n} for h, n in x] for x in out["lines"]]
        yield pd.concat([b[["doc_id", "host", "text_key"]].reset_index(drop=True), out], axis=1)[
            ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        ].astype({"doc_id": "Int64"})


def measured(docs: DataFrame) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("text_key"), "text")
    return src.mapInPandas(_measure, SCHEMA)


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def verdicts(docs: DataFrame, *, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED, count: str = "texts") -> DataFrame:
    """One row per document: the counts, words on removed lines, base_failed, kept, keys (host_key, k, text_key) and removed lines.

    Lines are counted over the distinct "texts" of a host, or over its distinct "ids" (a null id is one).
    """
    if count not in ("texts", "ids"):
        raise ValueError(f"count must be texts or ids, not {count}")
    m = common.cut(measured(docs), "quality")
    host = host_key(F.col("host")).alias("host")
    one = m.select(host, "doc_id", "text_key", "lines")
    unit = (F.col("text_key") if count == "texts" else id_key(F.col("doc_id"))).alias("unit")
    lines = one.select("host", "doc_id", "text_key", F.explode("lines").alias("l")).select("host", "doc_id", "text_key", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    sizes = one.select("host", unit).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # equal (host, line, text) are dropped before anything is counted by line, so that a line of many copies is no hot key
    often = lines.select("host", "h", unit).distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    often = common.cut(often.join(sizes, "host").where(F.col("docs") > F.col("host_docs") * line_share).select("host", "h"), "often")
    gone = lines.join(often, ["host", "h"], "left_semi")
    key = ["host", id_key(F.col("doc_id")).alias("k"), "text_key"]
    # repeated rows have the same lines: an average over the copies is the count of one of them
    copies = one.groupBy(*key).agg(F.count("*").alias("copies"))
    gone = gone.groupBy(*key).agg(F.sum("n").alias("gone"), F.collect_set("h").alias("removed")).join(copies, ["host", "k", "text_key"]).select(
        F.col("host").alias("host_key"), "k", "text_key", "removed", F.expr("gone div copies").alias("n_removed_words")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = m.drop("lines").withColumns({"k": id_key(F.col("doc_id")), "host_key": host}).join(gone, ["host_key", "k", "text_key"], "left")
    removed = F.coalesce("n_removed_words", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - removed >= depleted * F.col("n_words"))).alias("kept"),
        removed.cast("long").alias("n_removed_words"), "text_key", "host_key", "k", "removed",
    )


def assess(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: the counts, words on removed lines, base_failed, and kept."""
    return verdicts(docs, **limits).drop("host_key", "k", "removed")


def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines of these hashes."""

    def left(t: str, gone: set[int]) -> str:
        return "\n".join(x for x in t.split("\n") if not (common.words(x) and line_hash(x) in gone))

    return pd.Series([t if t is None or r is None else left(t, set(map(int, r))) for t, r in zip(text, removed, strict=True)], dtype=object)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are not rejected, without their lines above the limits, with their own columns; n_chars counted anew."""
    v = verdicts(docs, **limits).where("not kept or removed is not null").select("host_key", "k", "text_key", "kept", "removed")
    v = v.dropDuplicates(["host_key", "k", "text_key"])
    d = docs.select(
        common.packed(docs), host_key(F.col("source").cast("string")).alias("host_key"), id_key(F.col("doc_id")).alias("k"), F.xxhash64("text").alias("text_key")
    )
    d = d.join(v, ["host_key", "k", "text_key"], "left").where(F.coalesce("kept", F.lit(True)))
    changed = F.col("removed").isNotNull()
    text = F.when(changed, F.pandas_udf(without_lines, "string")("row.text", "removed")).otherwise(F.col("row.text"))
    d = d.select("row", "removed", text.alias("text"))
    return common.unpacked(d, docs, text=F.col("text"), n_chars=F.when(changed, F.length("text")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(common.read(spark, sf_dir, "documents")).drop("text_key")
