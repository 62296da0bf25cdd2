"""Many needles at once: all whole-word places of a list of texts in one text.

Up to FEW needles are looked for one by one in the JVM. More of them become one automaton (a trie
with failure links), so that a text is read once however many there are: the cost grows with the
text, the needles and the hits. Automata of equal lists are built once per task.
"""

from __future__ import annotations

import unicodedata
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.spans import cuts, running, whole_word_occurrences

FEW = 8
KEPT = 4  # automata that a task remembers
HIT = "struct<start:int,end:int,needle:int>"
HITS = f"array<{HIT}>"
RANGE = "array<struct<start:int,end:int>>"


def _wordy(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM"


def automaton(needles: tuple[str | None, ...]):
    """An Aho-Corasick automaton over the needles that are not empty; its values are their places in the list and lengths."""
    import ahocorasick

    a = ahocorasick.Automaton()
    of: dict[str, list[int]] = {}
    for i, w in enumerate(needles):
        if w:
            of.setdefault(w, []).append(i)
    for w, places in of.items():
        a.add_word(w, (len(w), places))
    a.make_automaton()
    return a


def places_in(text: str, a) -> list[tuple[int, int, int]]:
    """(start, end, needle) of the whole-word occurrences of an automaton's needles, overlapping ones included."""
    out: list[tuple[int, int, int]] = []
    if not len(a):
        return out
    for last, (n, needles) in a.iter(text):
        start, end = last + 1 - n, last + 1
        if start and _wordy(text[start - 1]) and _wordy(text[start]):
            continue
        if end < len(text) and _wordy(text[end]) and _wordy(text[last]):
            continue
        out += [(start, end, i) for i in needles]
    return sorted(out)


def _many(texts: pd.Series, lists: pd.Series) -> pd.Series:
    kept: OrderedDict = OrderedDict()
    out = []
    for t, needles in zip(texts, lists, strict=True):
        if t is None or needles is None:
            out.append(None)
            continue
        key = tuple(needles)
        a = kept.pop(key, None) or automaton(key)
        kept[key] = a
        if len(kept) > KEPT:
            kept.popitem(last=False)
        out.append([{"start": s, "end": e, "needle": i} for s, e, i in places_in(t, a)])
    return pd.Series(out, dtype=object)


def places(text: Column, needles: Column) -> Column:
    """array<struct<start,end,needle>> sorted by start: all whole-word places of the needles (an array) in a text; needle is the index."""
    one = lambda t, i: F.transform(whole_word_occurrences(text, t), lambda s: F.struct(s.alias("start"), (s + F.length(t)).alias("end"), i.alias("needle")))
    few = F.array_sort(F.flatten(F.transform(needles, one)).cast(HITS))
    many = F.size(needles) > FEW
    udf = F.pandas_udf(_many, HITS).asNondeterministic()  # evaluated once, where it stands
    return F.when(many, udf(F.when(many, text), F.when(many, needles))).otherwise(few)


def united(hits: Column) -> Column:
    """array<struct<start,end>>: sorted hits as disjoint ranges; those that overlap or touch are one."""

    def heads(h: Column, reach: Column) -> Column:
        first = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x["start"] > F.get(reach, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
        whole = lambda f: F.transform(f, lambda i, k: F.struct(F.get(h, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(f, k + 1), F.size(h)) - 1).alias("end")))
        return F.transform(F.array(first), whole)[0]

    ends = lambda h: F.array(running(F.transform(h, lambda x: x["end"]), F.greatest))
    return F.transform(F.array(hits), lambda h: F.transform(ends(h), lambda reach: heads(h, reach))[0])[0].cast(RANGE)


def without(text: Column, ranges: Column) -> Column:
    """A text without disjoint sorted ranges: what lies between them, joined."""
    gap = lambda r, i: F.struct(F.coalesce(F.get(r, i - 1)["end"], F.lit(0)).alias("start"), F.coalesce(F.get(r, i)["start"], F.length(text)).alias("end"))
    gaps = F.transform(F.array(ranges), lambda r: F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: gap(r, i)))[0]
    kept = F.transform(F.array(gaps), lambda g: F.array_join(cuts(text, g), ""))[0]
    return F.when(text.isNotNull() & (F.size(ranges) > 0), kept).otherwise(text)
