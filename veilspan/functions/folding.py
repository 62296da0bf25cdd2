"""Unicode folding in the JVM: tables derived once from `unicodedata`, and a scan over the places where offsets change.

NFKC and lower-casing map most characters to one character, which one `translate` does for a whole
text. What changes offsets is found by one pattern: clusters with marks, runs of white space, dropped
characters and characters that expand. Clusters whose marks would have to be reordered or composed
in several steps are `hard`; they are few and left to the caller.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.spans import empty, plus, running

DROPPED = "​‌‍⁠﻿­"
NO_SPACE = "\x1c\x1d\x1e\x1f"
BUCKETS = 61  # maps are searched from end to end, so the table is split by first character


def charclass(chars: Iterable[str]) -> str:
    """The inside of a character class, as ranges of code points."""
    ranges: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == x - 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@functools.cache
def tables() -> dict:
    """single: one-to-one foldings; longer: foldings of expanding characters and of composing pairs; patterns."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    fold = {c: unicodedata.normalize("NFKC", c).lower() for c in every}
    space = [c for c in every if c.isspace() and c not in NO_SPACE]
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    single = {c: f for c, f in fold.items() if f != c and len(f) == 1} | dict.fromkeys(space, " ")
    expanding = {c: f for c, f in fold.items() if len(f) > 1}
    pairs = {}
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == c:
                pairs[pair] = fold[c]
    changing = [c for c in every if unicodedata.normalize("NFKC", c) != c]
    marked = set(marks)
    restless = marked & ({c for c in marks if unicodedata.combining(c)} | {p[1] for p in pairs} | set(changing))
    composite = [c for c in every if c not in marked and len(unicodedata.normalize("NFD", c)) > 1]
    d, w, e, s = (charclass(x) for x in (DROPPED, space, set(expanding) - marked, restless))
    bases = charclass((set(changing) | set(expanding) | set(DROPPED) | set(space)) - marked - {" "})
    # large classes are searched range by range, so a look ahead at the kind of the next characters comes first
    return {
        "single": ("".join(single), "".join(single.values())), "longer": {k: v for k, v in (expanding | pairs).items() if k not in marked}, "drop": f"[{d}]", "space": f"[{w}]",
        "special": rf"\P{{M}}\p{{M}}+|(?:[{d}{w}](?!\p{{M}})){{2,}}|[{d}](?!\p{{M}})|(?=[^\x00-\x9F])[{e}](?!\p{{M}})",
        "hard": rf"^\p{{M}}|(?=\P{{M}}\p{{M}})(?:[{bases}]\p{{M}}|[{charclass(composite)}][{s}])|(?=\p{{M}}\p{{M}})(?:[{s}]\p{{M}}|\p{{M}}[{s}])|(?=\p{{M}})[{charclass(marked & set(changing))}]",
    }


def single(text: Column) -> Column:
    """All one-to-one foldings, and every white-space character a space."""
    return F.translate(text, *tables()["single"])


def is_plain(text: Column) -> Column:
    """Every character folds to one character, at its own place."""
    return ~text.rlike(tables()["special"])


def is_hard(text: Column) -> Column:
    """Marks to be composed in several steps or reordered, or code points that are newer than the JVM's Unicode."""
    return text.rlike(r"[\p{M}\p{Cn}]") & (text.rlike(tables()["hard"]) | text.rlike(r"\p{Cn}"))


def _longer(value: Column) -> Column:
    """The folding of an expanding character or a composing pair, else of each character."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for k, v in tables()["longer"].items():
        buckets[ord(k[0]) % BUCKETS][k] = v
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return F.coalesce(F.try_element_at(F.get(table, F.ascii(value) % BUCKETS), value), single(value))


def folded(text: Column) -> Column:
    """struct<n,starts,ends> of a text that is not hard: the normalised form, and the range in the text of each of its characters."""
    t = tables()
    p = F.lit(t["special"])
    gaps, values = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
    kind = "struct<start:int,end:int,f:string>"

    def unit(value: Column, end: Column) -> Column:
        """What a special place becomes: its form, and the range that each character of it stands for."""
        start = end - F.length(value)
        runs = ~value.rlike(r"\p{M}") & value.rlike(f"^(?:{t['drop']}|{t['space']})")
        lead = start + F.length(F.regexp_extract(value, f"^{t['drop']}*", 0))  # a run of white space is its first character
        blank = F.struct(lead.alias("start"), (lead + 1).alias("end"), F.when(value.rlike(t["space"]), " ").otherwise("").alias("f"))
        return F.when(runs, blank.cast(kind)).otherwise(F.struct(start.alias("start"), end.alias("end"), _longer(value).alias("f")).cast(kind))

    zipped = F.arrays_zip(gaps.alias("gap"), values.alias("value"))  # the last gap has no value

    def build(z: Column) -> Column:
        size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))
        rows = F.zip_with(z, running(F.transform(z, size), plus), lambda x, end: F.struct(
            x["gap"].alias("gap"), (end - size(x)).alias("at"), F.when(x["value"].isNotNull(), unit(x["value"], end)).alias("u")))
        return F.transform(F.array(rows), whole)[0]

    def whole(r: Column) -> Column:
        def places(shift: int, name: str) -> Column:
            plain = lambda x: F.when(F.length(x["gap"]) > 0, F.sequence(x["at"] + shift, x["at"] + F.length(x["gap"]) - 1 + shift)).otherwise(empty("array<int>"))
            special = lambda x: F.when(x["u"].isNotNull(), F.array_repeat(x["u"][name], F.length(x["u"]["f"]))).otherwise(empty("array<int>"))
            return F.flatten(F.transform(r, lambda x: F.concat(plain(x), special(x)))).alias("starts" if name == "start" else "ends")

        n = F.array_join(F.transform(r, lambda x: F.concat(single(x["gap"]), F.coalesce(x["u"]["f"], F.lit("")))), "")
        return F.struct(n.alias("n"), places(0, "start"), places(1, "end"))

    return F.transform(F.array(zipped), build)[0]
