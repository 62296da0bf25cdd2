"""Normalised text with exact offsets into the original.

Texts whose characters NFKC and lower-casing map one to one, without white-space runs, need no
offsets: `starts` and `ends` are null. Latin ones among them (stable) take the cheapest way. All others
are folded in the JVM too (`folding`), except those with marks to be reordered or composed in several
steps, which travel to an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import folding

# A character outside the first class, or two white-space characters in a row, make a text unstable;
# most texts need the cheaper test of the second class only.
_ODD, _NOT_ASCII = r"[^\t\n\f\r -~À-ÖØ-öø-įĴ-ľŁ-ňŊ-ž‘’“”–—€]", r"[^\t\n\f\r -~]"
_DROPPED = regex.compile("[​-‍⁠﻿­]")
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")


def normalize(text: str) -> tuple[str, list[int], list[int]]:
    """Fold each cluster (a character with its marks) by NFKC and lower-casing; each unit keeps its cluster's range."""
    out, starts, ends = [], [], []
    spaced = False
    for m in _CLUSTER.finditer(text):
        folded = unicodedata.normalize("NFKC", m[0]).lower()
        for piece in _CLUSTER.findall(folded):
            if _DROPPED.search(piece):
                continue
            if piece.isspace() and piece not in "\x1c\x1d\x1e\x1f":
                if spaced:
                    continue
                piece, spaced = " ", True
            else:
                spaced = False
            out.append(piece)
            starts += [m.start()] * len(piece)
            ends += [m.end()] * len(piece)
    return "".join(out), starts, ends


def fast(text: Column) -> Column:
    """The normalised form of a stable text."""
    return F.lower(F.translate(text, "\t\n\f\r", "    "))


def is_stable(text: Column) -> Column:
    return ~(F.translate(text, "\t\n\f\r", "    ").contains("  ") | (text.rlike(_NOT_ASCII) & text.rlike(_ODD)))


def _normalized(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if t is None else normalize(t) for t in texts], columns=["n", "starts", "ends"], dtype=object)


_KIND = "struct<n:string,starts:array<int>,ends:array<int>>"


def normalized(text: Column) -> Column:
    """struct<n,starts,ends> of a text that is not stable; Python sees the hard ones only."""
    udf = F.pandas_udf(_normalized, _KIND).asNondeterministic()  # evaluated once, where it stands
    odd = F.transform(F.array(F.when(~is_stable(text), text)), lambda t: F.when(folding.is_hard(t), F.lit(None)).when(
        folding.is_plain(t), F.struct(folding.single(t).alias("n"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends")).cast(_KIND)
    ).otherwise(folding.folded(t).cast(_KIND)))[0]
    return F.coalesce(odd, udf(F.when(~is_stable(text) & folding.is_hard(text), text)))


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id and text with n, starts and ends (both null where every character keeps its place)."""
    d = docs.select("doc_id", "text", normalized(F.col("text")).alias("u"))
    return d.select("doc_id", "text", F.coalesce("u.n", fast(F.col("text"))).alias("n"), "u.starts", "u.ends")


def form(text: Column) -> Column:
    """The normalised form of any text, without places."""
    return F.coalesce(normalized(text)["n"], fast(text))


def with_form(df: DataFrame, text: str) -> DataFrame:
    """df with n, the normalised form of a text without places: runs of plain white space are one space beforehand, and most texts then need no folding."""
    d = df.withColumn("_spaced", F.regexp_replace(text, r"[\t\n\f\r ]{2,}(?!\p{M})", " "))
    return d.withColumn("n", form(F.col("_spaced"))).drop("_spaced")


def key(text: Column) -> Column:
    """The key of a redaction: the trimmed normalised form."""
    return F.trim(form(text))


def _forms(lists: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [None if t is None else normalize(t)[0] for t in ts] for ts in lists], dtype=object)


MARKS = r"[\p{M}\p{Cn}]"  # no text is hard without these


def keys(texts: Column, marks: bool = True) -> Column:
    """The keys of an array of texts; the hard ones of an array travel together, and only if there are any. marks: whether there can be any."""
    odd = lambda t: F.when(folding.is_hard(t), F.lit(None)).when(folding.is_plain(t), folding.single(t)).otherwise(folding.folded(t)["n"])
    form = lambda t: F.when(is_stable(t), fast(t)).otherwise(odd(t))
    if not marks:
        return F.transform(texts, lambda t: F.trim(form(t)))
    hard = F.transform(texts, lambda t: F.when(~is_stable(t) & folding.is_hard(t), t))
    some = F.array_join(texts, " ").rlike(MARKS)
    udf = F.pandas_udf(_forms, "array<string>").asNondeterministic()(F.when(some, hard))  # evaluated once, where it stands
    return F.zip_with(texts, F.coalesce(udf, F.array().cast("array<string>")), lambda t, h: F.trim(F.coalesce(h, form(t))))
