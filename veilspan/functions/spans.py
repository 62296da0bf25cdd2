"""Spans as columns: matches with offsets, word boundaries, boxes, and the candidate type.

Offsets are code points in half-open ranges. A list of matches is an
array<struct<start,end,value,grp>>, found by splitting a text at a pattern and adding up lengths,
so that patterns keep their lookaround and no marker has to be put into the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = [
    "PERSON", "ORGANIZATION", "LOCATION", "EMAIL", "PHONE", "URL", "IBAN", "PAYMENT_CARD", "IT_TAX_CODE", "IT_VAT", "ID_DOCUMENT", "VEHICLE_PLATE",
    "CONTEXTUAL_ID",
]
CONFIDENCE = ["low", "medium", "high"]  # rank is the position
CANDIDATE = "struct<start:int,end:int,category:string,confidence:string,method:string,rule:string>"
CANDIDATES = f"array<{CANDIDATE}>"
MATCHES = "array<struct<start:int,end:int,value:string,grp:string>>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def sql(pattern: str) -> str:
    """A regular expression as a raw SQL literal; apostrophes are written as escapes."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def any_of(words: list[str], escape: bool = True) -> str:
    """An alternation, longest first where plain words could be prefixes of others."""
    parts = [re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", w).replace("'", r"\x27") for w in words] if escape else list(words)
    return "(?:" + "|".join(parts) + ")"


def by_initial(forms: list[str]) -> str:
    """An alternation of forms that begin with a plain letter, tried by their first letter only; forms of one letter keep their order."""
    groups: dict[str, list[str]] = {}
    for f in forms:
        groups.setdefault(f[0], []).append(f[1:])
    return f"(?=[{''.join(groups)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


BLOCK = 256  # values of one inner fold of `running`


def _fold(values: Column, step) -> Column:
    return F.aggregate(values, empty("array<int>"), lambda a, x: F.array_append(a, F.coalesce(step(F.get(a, F.size(a) - 1), x), x)))


def running(values: Column, step) -> Column:
    """array<int>: an array of ints folded up to each of its places, by an associative step (sums, maxima).

    An array that grows by appending is copied each time, so long ones are folded in blocks, and the
    blocks' totals on their own.
    """

    def in_blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: _fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), step))
        totals = lambda p: F.array(_fold(F.transform(p, lambda q: F.get(q, F.size(q) - 1)), step))
        raised = lambda q, before: F.transform(q, lambda x: F.coalesce(step(before, x), x))
        return F.transform(F.array(parts), lambda p: F.transform(totals(p), lambda t: F.flatten(F.transform(p, lambda q, i: raised(q, F.get(t, i - 1)))))[0])[0]

    return F.transform(F.array(values), lambda v: F.when(F.size(v) <= BLOCK, _fold(v, step)).otherwise(in_blocks(v)))[0]


def plus(a: Column, b: Column) -> Column:
    return a + b


def _placed(text: Column, p: Column, values: Column, grp: Column | None, zero_width: bool) -> Column:
    """Matches with their places: each begins where the piece before it ends."""
    gaps = F.split(text, p, -1)
    if zero_width:  # a match at the very beginning leaves no empty piece before it
        gaps = F.transform(F.array(gaps), lambda g: F.when(F.size(g) == F.size(values), F.concat(F.array(F.lit("")), g)).otherwise(g))[0]
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"), (values if grp is None else grp).alias("grp"))

    def at(z: Column) -> Column:
        size = (lambda x: F.length(x["gap"])) if zero_width else (lambda x: F.length(x["gap"]) + F.length(x["value"]))
        start = (lambda x, k: k) if zero_width else (lambda x, k: k - F.length(x["value"]))
        return F.zip_with(z, running(F.transform(z, size), plus), lambda x, k: F.struct(start(x, k).alias("start"), (start(x, k) + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["grp"].alias("grp")))

    return F.transform(F.array(zipped), at)[0]


def find(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches the empty string.

    A text without a match is read once. gate: a cheap condition without which there is no match.
    """
    p = F.lit(pattern)
    grp = F.regexp_extract_all(text, p, F.lit(group)) if group else None
    found = F.transform(F.array(F.regexp_extract_all(text, p, F.lit(0))), lambda v: F.when(F.size(v) > 0, _placed(text, p, v, grp, False)).otherwise(empty(MATCHES)))[0]
    return F.coalesce(found if gate is None else F.when(gate, found), empty(MATCHES))


def find_at_starts(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Matches of a zero-width pattern whose group 1 looks ahead: every start is tried, so values may overlap."""
    p = F.lit(pattern)
    found = F.transform(F.array(F.regexp_extract_all(text, p, F.lit(1))), lambda v: F.when(F.size(v) > 0, _placed(text, p, v, None, True)).otherwise(empty(MATCHES)))[0]
    return F.coalesce(found if gate is None else F.when(gate, found), empty(MATCHES))


def context(n: str, start: str, keywords: list[str], window: int) -> str:
    """SQL: a keyword begins, at a word's left edge, within `window` characters before start."""
    before = f"substring({n}, greatest({start} - {window}, 0) + 1, least({window}, {start}))"
    return f"{before} rlike {sql('(^|[^\\p{L}\\p{N}])' + any_of(keywords))}"


def has_context_before(n: Column, start: Column, keywords: list[str], window: int = 40) -> Column:
    before = F.substring(n, F.greatest(start - window, F.lit(0)) + 1, F.least(F.lit(window), start))
    return before.rlike(r"(^|[^\p{L}\p{N}])" + any_of(keywords))


def rank(confidence: Column | str) -> Column:
    """0, 1, 2 for low, medium, high; comparing confidences is comparing ranks."""
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), confidence).cast("int") - 1


# --- pieces of a text --------------------------------------------------------------------------
CELL_BITS = 8
CELL = 1 << CELL_BITS
FEW_PIECES = 8


def cuts(text: Column, ranges: Column) -> Column:
    """array<string>: what lies in each of an array of ranges (start, end, ...) of a text.

    A piece of a text is found by counting characters from its beginning, so a text with more than a
    few ranges is cut into cells first, in one pass, and each range is looked up in its cells.
    """
    direct = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])

    def near(cells: Column, x: Column) -> Column:
        first, last = (F.shiftright(at, CELL_BITS).cast("int") for at in (x["start"], x["end"] - 1))
        held = F.when(first == last, F.get(cells, first)).otherwise(F.array_join(F.slice(cells, first + 1, last - first + 1), ""))
        own = F.substring(held, (x["start"].bitwiseAND(CELL - 1) + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        return F.when(x["start"] < 0, direct(x)).when(x["end"] <= x["start"], F.lit("")).otherwise(own)

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))
    many = F.transform(F.array(whole), lambda cells: F.transform(ranges, lambda x: near(cells, x)))[0]
    return F.when(F.size(ranges) <= FEW_PIECES, F.transform(ranges, direct)).otherwise(many)


def runs(items: Column, same) -> Column:
    """array<array>: an array cut between neighbours that are not the same."""

    def cut(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~same(F.get(s, i - 1), x), i).otherwise(-1)), lambda i: i >= 0)
        return F.transform(F.array(heads), lambda h: F.transform(h, lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - i)))[0]

    return F.transform(F.array(items), cut)[0]


def counted(ascending: Column, upto) -> Column:
    """How many numbers of an ascending array are at most each of an array `upto`: array<int>, by bisection."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size(ascending), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    look = lambda a, p, x: F.aggregate(p, F.lit(0), lambda at, step: F.when(F.get(a, at + step - 1) <= x, at + step).otherwise(at))
    return F.transform(F.arrays_zip(F.array(ascending).alias("a"), F.array(steps).alias("p")), lambda b: F.transform(upto, lambda x: look(b["a"], b["p"], x)))[0]


# --- ranges and boxes --------------------------------------------------------------------------
def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Touching ranges do not overlap."""
    return (a_start < b_end) & (b_start < a_end)


def range_error(start: Column, end: Column) -> Column:
    return F.when((start >= 0) & (end > start), F.lit(None)).otherwise(F.lit("invalidCharRange"))


def candidate_error(text: Column, start: Column, end: Column) -> Column:
    """Why a candidate is refused: outside the text (or empty), or blank."""
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.when(~inside, F.lit("outOfText")).when(F.substring(text, start + 1, end - start).rlike(r"^\s*$"), F.lit("blank"))


def box_error(x: Column, y: Column, w: Column, h: Column) -> Column:
    finite = F.lit(True)
    for v in (x, y, w, h):
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite & (w > 0) & (h > 0), F.lit(None)).otherwise(F.lit("invalidBoundingBox"))


def page_error(page: Column) -> Column:
    return F.when((page >= 0) & (page == F.floor(page)), F.lit(None)).otherwise(F.lit("invalidPageIndex"))


def area_error(page: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.coalesce(page_error(page), box_error(x, y, w, h))


def boxes_intersect(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch do not intersect. Columns are structs of x, y, w, h."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def box_contains(outer: Column, inner: Column, tolerance: float = 0.0) -> Column:
    t = F.lit(tolerance)
    return (
        (inner["x"] >= outer["x"] - t) & (inner["y"] >= outer["y"] - t)
        & (inner["x"] + inner["w"] <= outer["x"] + outer["w"] + t) & (inner["y"] + inner["h"] <= outer["y"] + outer["h"] + t)
    )


def hull(box: Column) -> Column:
    """Aggregate: the union of boxes (null for none)."""
    x, y = F.min(box["x"]), F.min(box["y"])
    full = F.struct(x.alias("x"), y.alias("y"), (F.max(box["x"] + box["w"]) - x).alias("w"), (F.max(box["y"] + box["h"]) - y).alias("h"))
    return F.when(F.count(box["x"]) > 0, full)


# --- whole words -------------------------------------------------------------------------------
_WORDY = r"^[\p{L}\p{N}\p{M}]$"


def is_whole_word(text: str, start: str, end: str) -> str:
    """SQL: neither edge has a letter, number or mark on both of its sides."""

    def edge(inner: str, outer: str) -> str:
        w = sql(_WORDY)
        return f"not (substring({text}, {inner}, 1) rlike {w} and {outer})"

    w = sql(_WORDY)
    left = edge(f"{start} + 1", f"{start} > 0 and substring({text}, {start}, 1) rlike {w}")
    right = edge(end, f"substring({text}, {end} + 1, 1) rlike {w}")
    return f"({left} and {right})"


def whole_word_occurrences(text: Column, needle: Column) -> Column:
    """array<int>: starts of all whole-word occurrences, overlapping ones included; none for an empty needle.

    A needle that cannot overlap itself is what one split takes out of the text; others are looked
    ahead for at every place.
    """
    w, none = r"[\p{L}\p{N}\p{M}]", empty("array<int>")
    left = F.when(F.substring(needle, 1, 1).rlike(f"^{w}$"), F.lit(f"(?<!{w})")).otherwise(F.lit(""))
    right = F.when(F.right(needle, F.lit(1)).rlike(f"^{w}$"), F.lit(f"(?!{w})")).otherwise(F.lit(""))
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), right)

    def consumed(gaps: Column) -> Column:
        ends = running(F.transform(gaps, lambda g: F.length(g) + F.length(needle)), plus)
        return F.transform(F.slice(ends, F.lit(1), F.size(gaps) - 1), lambda e: e - F.length(needle))

    def ahead(gaps: Column) -> Column:  # nothing is taken out, and nothing stands before a match at the very beginning
        p = F.concat(left, F.lit("(?="), quoted, F.lit(")"))
        full = F.when(F.size(gaps) == F.regexp_count(text, p), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
        return F.transform(F.array(full), lambda g: running(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), F.length), plus))[0]

    pieces = lambda p: F.array(F.split(text, p, -1))
    fast = F.transform(pieces(F.concat(left, quoted)), consumed)[0]
    slow = F.transform(pieces(F.concat(left, F.lit("(?="), quoted, F.lit(")"))), ahead)[0]
    overlaps_itself = F.exists(F.sequence(F.lit(0), F.length(needle) - 1), lambda k: (k > 0) & F.startswith(needle, F.right(needle, k)))
    return F.when((F.coalesce(F.length(needle), F.lit(0)) == 0) | ~F.contains(text, needle), none).when(overlaps_itself, slow).otherwise(fast)
