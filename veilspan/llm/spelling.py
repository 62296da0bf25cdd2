"""Spelling variants: words of a corpus that are one edit apart, and the frequent form each one stands for.

Words that differ by one inserted, deleted or replaced code point share at least half of their
code points at the beginning or at the end. So they meet in a list of words of equal or neighbouring
lengths with the same half. A sorted list is scanned: rows of the edit matrix, banded to the diagonal
and its neighbours, are kept for the prefix shared with the word before, and a range of words whose
common prefix is already more than one edit away is skipped by one binary search. Lists of more than
LIST words are split in the same way on what is still unknown of their words, until they are small or
one code point is left, so that no task holds more of them.

Defined results: null and empty texts have no words; repeated rows count each time; a null doc_id
counts as an empty text in the typo rule; equal counts are ordered by code point; an empty table has
no words; further columns are not read. Texts of any length are split where they are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

MIN_CHARS, MIN_COUNT, TYPOS, DOMINANCE = 6, 5, 199, 5
LIST = 2_000  # most words of a scanned list, unless only one code point of them is unknown
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def runs(text: Column) -> Column:
    """The maximal letter runs of at least MIN_CHARS code points (shorter ones are no words), A-Z in small letters."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}"), F.lit(0))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all documents with at least MIN_COUNT occurrences.

    A run loses a code point if TYPOS divides the checksum of its document and itself.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col("text").cast("string"))).alias("run"))
    d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    d = d.select(F.when(F.col("h") % TYPOS == 0, short).otherwise(F.col("run")).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_CHARS))


# --- one sorted list ---------------------------------------------------------------------------
def common_prefixes(words: list[str]) -> list[int]:
    """How many code points each word shares with the word before it."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        most, k = min(len(a), len(b)), 0
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def near_in_list(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all two words of a sorted list of distinct words that are one edit apart, the earlier first.

    rows[d]: the edits between the scanned word's first d code points and the query's first d - 1,
    d and d + 1 (2 for any number above 1, and where the query is shorter).
    """
    shared = common_prefixes(words)
    rows: list[tuple[int, int, int]] = [(2, 0, 1)] + [(2, 2, 2)] * max(map(len, words), default=0)
    for q, query in enumerate(words):
        size = len(query)
        padded = query + "\0\0"
        i, depth = q + 1, 0
        while i < len(words):
            word = words[i]
            n = len(word)
            d = min(depth, shared[i])
            a, b, c = rows[d]
            alive = True
            while d < n:
                x = word[d]
                a = min(a if d and query[d - 1] == x else a + 1, b + 1)
                b = min(b if padded[d] == x else b + 1, c + 1, a + 1) if d < size else 2
                c = min(c if padded[d + 1] == x else c + 1, b + 1) if d + 1 < size else 2
                d += 1
                if a > 1 and b > 1 and c > 1:
                    alive = False
                    break
                rows[d] = (a, b, c)
                if d > size:  # nothing of the query is left, and a longer word is out of reach
                    break
            if not alive:
                i = bisect_left(words, word[:d] + LAST, i + 1)
                depth = d - 1
                continue
            depth = d
            if d == n and -1 <= size - n <= 1 and (a, b, c)[size - n + 1] == 1:
                yield q, i
            i += 1


# --- lists as tables ---------------------------------------------------------------------------
_KEYS = ["m", "l", "s", "pre", "suf"]


def _halved(words: DataFrame) -> DataFrame:
    """Each word of a list (keys m, l, s, pre, suf) in its two lists with half of the unknown code points more."""
    h = F.ceil((F.col("m") - F.col("l") - F.col("s") - 1) / 2).cast("int")
    more = F.explode(F.array(F.struct((F.col("l") + h).alias("l"), F.col("s").alias("s")), F.struct(F.col("l").alias("l"), (F.col("s") + h).alias("s")))).alias("k")
    w = words.select("word", "n", "m", more).select("word", "n", "m", "k.*")
    return w.withColumns({"pre": F.expr("substring(word, 1, l)"), "suf": F.expr("right(word, s)")})


def _scanned(lists: DataFrame) -> DataFrame:
    """(a, na, b, nb): near words of the lists (keys, word, n), which are sorted within partitions and scanned one after another."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words, counts = None, [], []

        def close() -> list[tuple[str, int, str, int]]:
            turn = slice(None, None, -1 if held is not None and held[0] == "s" else 1)
            return [(words[i][turn], counts[i], words[j][turn], counts[j]) for i, j in near_in_list(words)]

        for b in batches:
            found = []
            for g, w, n in zip(b["g"], b["w"], b["n"].tolist(), strict=True):
                if g != held:
                    found += close()
                    held, words, counts = g, [], []
                words.append(w)
                counts.append(n)
            yield pd.DataFrame(found, columns=["a", "na", "b", "nb"])
        yield pd.DataFrame(close(), columns=["a", "na", "b", "nb"])

    by_end = F.col("s") > F.col("l")  # words with the same end are read from there
    g = F.concat_ws("/", F.when(by_end, "s").otherwise("p"), "m", "l", "s", "pre", "suf")
    k = lists.select(g.alias("g"), F.when(by_end, F.reverse("word")).otherwise(F.col("word")).alias("w"), "n")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return k.repartition(parts, "g").sortWithinPartitions("g", "w").mapInPandas(scan, "a string, na long, b string, nb long")


def near_pairs(words: DataFrame, most: int = LIST) -> DataFrame:
    """(a, na, b, nb): all pairs of distinct words (word, n) that are one edit apart, each once."""
    # m is the length of the pair's shorter word: a word meets those of its length, one more and one less
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    lists = _halved(words.select("word", "n", m, F.lit(0).alias("l"), F.lit(0).alias("s")).where("m > 0"))
    found = None
    while True:
        lists = common.cut(lists, "spelling-lists")
        sizes = lists.groupBy(*_KEYS).agg(F.count("*").alias("size")).where("size > 1")  # a word alone has no pair
        sizes = sizes.withColumn("split", (F.col("size") > most) & (F.col("m") - F.col("l") - F.col("s") > 1))
        sizes = common.cut(sizes, "spelling-sizes")
        k = common.skewed_join(lists, sizes, _KEYS, "size")
        pairs = common.cut(_scanned(k.where("not split")), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where("split").isEmpty():
            return found.select(F.when(F.col("a") < F.col("b"), F.struct("a", "na", "b", "nb")).otherwise(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))).alias("p")).select("p.*").distinct()
        lists = _halved(k.where("split").select("word", "n", "m", "l", "s"))


def variants(docs: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents (doc_id, text)."""
    words = common.cut(vocabulary(docs), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("k")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    w = words.join(best, "word", "left")
    strong = -F.col("best.k") >= dominance * F.col("n")
    w = w.select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.k")).alias("form_n"))
    w = common.cut(w, "spelling-forms")
    # counts grow along forms, so there are no cycles; every round doubles the way to the root
    way = w.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = way.join(on, "root", "left")
        ahead = common.cut(ahead.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        way = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return w.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.read(spark, sf_dir, "documents"))
