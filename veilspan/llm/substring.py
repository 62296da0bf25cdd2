"""Substring dedup: words in 50-word passages that start in an earlier document go.

Anchors route the work: each 50-word window elects the smallest hash of its 8-word grams
(winnowing), so equal windows elect the same anchor at the same place. Only anchors seen in two
documents or more matter. Around each occurrence of an anchor lies its context, all words of the
windows that may have elected it. Contexts go to shards by anchor, each distinct one once, from its
earliest document (they are told apart by 128 bits). A shard builds a compressed FM-index over its
contexts (a wavelet tree on the Burrows-Wheeler transform of word symbols, with a minimum-document
table on the suffix order; symbols stand for the words themselves, not for hashes) and streams the
contexts through it: backward search extends a match word by word while it still occurs in an
earlier document, and matches of 50 words become reported intervals with the earliest document that
holds them. A failed search skips all windows that hold the failed piece. All removals come from
these reports: an occurrence of a context loses the reported intervals whose document is smaller.

An anchor with very many contexts does not enter one shard: its windows do, on their own, each
distinct window of two documents or more once, routed by its own hash. Before that, slices of SLICE
windows whose common words stand in one document only are left out.

Nulls: null or empty text has no words and loses none; a null doc_id counts as the largest id.
Repeated rows (one doc_id) never remove each other's words, as no id is smaller. Empty tables give
empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common
from veilspan.llm.common import GOLD, UNGOLD

WINDOW, GRAM = 50, 8
SPAN = WINDOW - GRAM + 1  # grams in a window
SHARD_CONTEXTS = 6_000  # contexts of a shard that the number of shards aims at
HOT = 2_000  # the windows of an anchor with more distinct contexts are routed one by one, at any size of the corpus
SLICE = 15  # windows of a hot anchor that are looked at together; they share WINDOW - SLICE + 1 words
LAST = 2**63 - 1
NONE = 2**31 - 1


def grams(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 8-word grams, from pairs, fours and eights."""
    for k in (1, 2, 4):
        h = h[:-k] * GOLD**np.uint64(k) + h[k:]
    return common.mix(h)


def anchors(g: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the grams that some window elects: smallest hash, leftmost on ties; row: the text of each word."""
    n = len(row) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # upper half: hash, lower half: place, so that the smallest is also the leftmost
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    # sliding minimum by prefix and suffix minima of blocks of SPAN
    x = np.append(key, np.full(-len(key) % SPAN, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, SPAN)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(right[:n], left[SPAN - 1 : SPAN - 1 + n])[row[:n] == row[WINDOW - 1 :]]
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


class RangeHashes:
    """Order-dependent 64-bit hashes of word ranges, from prefix sums of a polynomial."""

    def __init__(self, h: np.ndarray) -> None:
        power = np.cumprod(np.append(np.uint64(1), np.full(len(h), GOLD, np.uint64)))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(len(h), UNGOLD, np.uint64)))
        self.total = np.append(np.uint64(0), np.cumsum(common.mix(h + np.uint64(1)) * power[:-1]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return common.mix((self.total[hi] - self.total[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


class FMIndex:
    """Backward search for up to WINDOW symbols over concatenated contexts.

    Suffixes are sorted by their first 64 symbols or more, which is all that patterns of WINDOW
    symbols can see. Contexts end with a separator that no pattern holds. The sort also gives each
    place of the text the range of the suffixes that share its next `seed` symbols (24 or 32), so
    that a search for a piece of the indexed text starts with these symbols matched.
    """

    def __init__(self, symbols: np.ndarray, docs: np.ndarray) -> None:
        """symbols: 0 for separators, 1.. for words; docs: the document of each position, as ranks."""
        n = len(symbols)
        self.sigma = int(symbols.max(initial=0)) + 1
        self.n = n
        sa = self._suffixes(symbols)
        bwt = symbols[sa - 1]  # position -1 is the final separator
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=self.sigma)))
        self._wavelet(bwt)
        zero, self.zones = np.zeros(1, np.int64), np.zeros(self.sigma, np.int64)
        self.zones = self._down(np.repeat(zero, self.sigma), np.arange(self.sigma))
        # minima of documents over ranges of the suffix order
        self.low = [docs[sa].astype(np.int32)]
        width = 1
        while 2 * width <= n:
            prev = self.low[-1]
            self.low.append(np.minimum(prev[: n - 2 * width + 1], prev[width : n - width + 1]))
            width *= 2

    def _suffixes(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        sigma = int(symbols.max(initial=0)) + 1
        depth = 4 if sigma < 1 << 15 else 3 if sigma < 1 << 20 else 1
        # the first ranks are of whole pieces of `depth` symbols (positions past the end count as 0)
        rank = symbols.astype(np.int64)
        for i in range(1, depth):
            rank = rank * sigma + np.append(symbols[i:], np.zeros(i, np.int64))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - depth] = rank[depth:] + 1 if depth < n else 0
            key = rank * (int(nxt.max()) + 1) + nxt
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
            rank, depth = new, depth * 2
            if depth <= WINDOW:
                self.seed, self.rank = depth, rank.astype(np.int32)
                self.ranges = np.append(0, np.cumsum(np.bincount(rank)))
            if depth > WINDOW or rank[order[-1]] == n - 1:
                return order

    def _wavelet(self, bwt: np.ndarray) -> None:
        """One bit vector per level (highest bit first), packed in words with block counts."""
        self.levels = []
        self.bits = max(1, int(self.sigma - 1).bit_length())
        x = bwt.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (x >> b & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, np.uint8)), bitorder="little").view("<u8")
            before = np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))
            zeros = int(len(bit) - bit.sum())
            self.levels.append((b, packed, before, zeros))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    @staticmethod
    def _ones(level: tuple, i: np.ndarray) -> np.ndarray:
        _, packed, before, _ = level
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where places of the transform get to at the bottom of the tree on the way of a symbol."""
        for level in self.levels:
            ones = self._ones(level, at)
            at = np.where(symbol >> level[0] & 1, level[3] + ones, at - ones)
        return at

    def seeded(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the `seed` symbols at places of the indexed text."""
        r = self.rank[place]
        return self.ranges[r], self.ranges[r + 1]

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns symbol + P from the ranges of the patterns P."""
        k = len(symbol)
        both = self._down(np.concatenate([lo, hi]), np.concatenate([symbol, symbol]))
        base = self.first[symbol] - self.zones[symbol]
        return base + both[:k], base + both[k:]

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest rank in each non-empty range, NONE for empty ones."""
        out = np.full(len(lo), NONE, np.int32)
        size = hi - lo
        level = np.zeros(len(lo), np.int64)
        full = size > 0
        level[full] = np.frexp(size[full].astype(float))[1] - 1
        for v in np.unique(level[full]):
            own = np.flatnonzero(full & (level == v))
            t = self.low[int(v)]
            out[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << int(v))])
        return out


def matches(index: FMIndex, symbols: np.ndarray, start: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, first words and documents of windows that occur in an earlier document and cover all words that such windows cover.

    Lane k streams the context that begins at start[k] in symbols, testing the windows that start
    at 0 to last[k] (within the context), for documents before doc[k]. From the left, the
    window tested is the one that would cover most beyond what is decided; each success covers 50
    words, each failure rules out all windows that hold the failed piece.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    lane = np.flatnonzero(last >= 0)
    start, last, doc = start[lane], last[lane], doc[lane]
    cur = np.zeros(len(lane), np.int64)  # window under test
    low = cur.copy()  # smallest start not ruled out
    todo = cur.copy()  # words before this one are decided
    failed = np.zeros(len(lane), np.int64)  # all windows before this one are ruled out or tested
    got = np.zeros(len(lane), np.int64)  # words matched so far
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    while len(lane):
        fresh, old = np.flatnonzero(got == 0), np.flatnonzero(got)
        if len(old):
            lo[old], hi[old] = index.extend(lo[old], hi[old], symbols[start[old] + cur[old] + WINDOW - 1 - got[old]])
            got[old] += 1
        if len(fresh):  # a window's last words
            lo[fresh], hi[fresh] = index.seeded(start[fresh] + cur[fresh] + WINDOW - index.seed)
            got[fresh] = index.seed
        low_doc = index.earliest(lo, hi)
        ok = low_doc < doc
        done = ok & (got == WINDOW)
        if done.any():
            out.append((lane[done], cur[done].copy(), low_doc[done].astype(np.int64)))
            todo[done] = cur[done] + WINDOW
            low[done] = np.maximum(cur[done] + 1, failed[done])
            cur[done] = np.maximum(todo[done], low[done])
        bad = ~ok
        if bad.any():
            # the piece of `got` words ending at cur + WINDOW does not occur earlier
            failed[bad] = np.maximum(failed[bad], cur[bad] + WINDOW - got[bad] + 1)
            down = bad & (cur - 1 >= low)
            cur[down] -= 1
            on = bad & ~down
            todo[on] = np.maximum(todo[on], failed[on])
            low[on] = np.maximum(low[on], failed[on])
            cur[on] = np.maximum(todo[on], low[on])
        over = done | bad
        # windows beyond the last are not this context's to test: look at the nearest that is
        late = over & (cur > last)
        cur[late] = np.maximum(last[late], low[late])
        got[over], lo[over], hi[over] = 0, 0, index.n
        live = ~(over & (cur > last))
        if not live.all():
            lane, start, last, doc, cur, low, todo, failed, got, lo, hi = (x[live] for x in (lane, start, last, doc, cur, low, todo, failed, got, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def indexed(pieces: list[bytes], doc: np.ndarray) -> tuple[FMIndex, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The index of texts, its symbols, where each text begins and how many words it has, and the sorted documents that ranks stand for."""
    codes: dict[bytes, int] = {}
    parts = [np.fromiter((codes.setdefault(w, len(codes) + 1) for w in p.split()), np.int64) for p in pieces]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[start + sizes] = False
    symbols[inside] = np.concatenate(parts)
    ranked, rank = np.unique(doc, return_inverse=True)
    return FMIndex(symbols, np.repeat(rank, sizes + 1)), symbols, start, sizes, ranked


def search(shard: pd.DataFrame) -> pd.DataFrame:
    """For each piece (key, ctx, doc, later, n, words) its reported windows: place of the first word, and the earliest document.

    later: whether documents after doc hold the piece, too, so that the windows that only doc holds matter as well.
    """
    shard = shard.drop_duplicates(["key", "ctx"], ignore_index=True)
    doc = shard["doc"].to_numpy(np.int64)
    index, symbols, start, sizes, ranked = indexed(list(shard["words"]), doc)
    rank = np.searchsorted(ranked, doc)
    last = sizes - WINDOW
    found = [matches(index, symbols, start, last, rank)]
    later = np.flatnonzero(shard["later"].to_numpy(bool))
    lane, at, first = matches(index, symbols, start[later], last[later], rank[later] + 1)
    found.append((later[lane], at, first))
    lane, at, first = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lane, kind="stable")
    lane, at, first = lane[order], at[order], ranked[first[order]]
    own, head = np.unique(lane, return_index=True)
    ats, firsts = np.split(at, head[1:]) if len(own) else [], np.split(first, head[1:]) if len(own) else []
    return pd.DataFrame({
        "key": shard["key"].to_numpy()[own], "ctx": shard["ctx"].to_numpy()[own], "n": shard["n"].to_numpy()[own],
        "ats": pd.Series([x.astype(np.int32) for x in ats], dtype=object), "firsts": pd.Series(list(firsts), dtype=object),
    })


# ------------------------------------------------------------------------------- Spark jobs
_REPORT = "key long, ctx long, n long, ats array<int>, firsts array<long>"
_PIECE = "key long, ctx long, doc long, later boolean, n long, words binary"
_PIECE_COLS = ["key", "ctx", "doc", "later", "n", "words"]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.portions(batches, "text"):
        w = common.Words(b["text"])
        h = w.hashes()
        g = grams(h) if len(h) >= WINDOW else np.zeros(0, np.uint64)
        at = anchors(g, w.row)
        row = w.row[at]
        lo, hi = np.maximum(w.first[row], at - SPAN + 1), np.minimum(w.first[row + 1], at + WINDOW)
        # windows may be cut off by the text's ends: the anchor's place is part of the context
        ctx = common.mix(RangeHashes(h).of(lo, hi) ^ common.mix((at - lo).astype(np.uint64)))
        base = w.first[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[at].view(np.int64)), pa.array(ctx.view(np.int64)), b["doc"].take(pa.array(row)), b["text_key"].take(pa.array(row)),
             pa.array((at - base).astype(np.int32)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
            ["key", "ctx", "doc", "text_key", "pos", "lo", "hi"],
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of ranges: rows (doc, text, want: array of (key, ctx, lo, hi, later, n)) to pieces."""
    for b in common.portions(batches, "text"):
        w = common.Words(b["text"])
        raw = w.data.tobytes()
        want = b["want"]
        row = want.value_parent_indices()
        x = want.flatten()
        base = w.first[row.to_numpy()]
        frm = w.start[base + x.field("lo").to_numpy()].tolist()
        to = w.end[base + x.field("hi").to_numpy() - 1].tolist()
        words = pa.array([raw[i:j] for i, j in zip(frm, to, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([x.field("key"), x.field("ctx"), b["doc"].take(row), x.field("later"), x.field("n"), words], _PIECE_COLS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of wanted contexts: the place of the first window in the context and in the text, the hash of the common words and those of the windows."""
    for b in common.portions(batches, "text"):
        w = common.Words(b["text"])
        hashes = RangeHashes(w.hashes())
        want = b["want"]
        owner = want.value_parent_indices().to_numpy()
        x = {c: want.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "ctx", "pos", "lo", "hi", "later", "n")}
        anchor = x["pos"] - x["lo"]
        top = np.minimum(anchor, x["hi"] - x["lo"] - WINDOW)  # the last window
        found = []
        for low in range(0, SPAN, SLICE):  # windows whose anchor is `low` to `high` words from their start
            high = min(low + SLICE, SPAN) - 1
            frm, to = np.maximum(0, anchor - high), np.minimum(top, anchor - low)
            i = np.flatnonzero(frm <= to)
            base = w.first[owner[i]] + x["lo"][i]
            core = common.mix(hashes.of(base + anchor[i] - low, base + anchor[i] - high + WINDOW) + np.uint64(low))
            size = to[i] - frm[i] + 1
            place = np.repeat(base + frm[i], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(hashes.of(place, place + WINDOW).view(np.int64)))
            found.append((i, frm[i], core, lists))
        own = np.concatenate([f[0] for f in found])
        at = np.concatenate([f[1] for f in found]).astype(np.int32)
        row = pa.array(owner[own])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x["key"][own]), pa.array(x["ctx"][own]), b["doc"].take(row), b["text_key"].take(row), pa.array(at), pa.array((x["lo"][own] + at).astype(np.int32)),
             pa.array(np.concatenate([f[2] for f in found]).view(np.int64)), pa.concat_arrays([f[3] for f in found]), pa.array(x["later"][own]), pa.array(x["n"][own])],
            ["key", "ctx", "doc", "text_key", "at", "lo", "core", "hashes", "later", "n"],
        )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed and the kept words, joined by one space."""
    for b in common.portions(batches, "text"):
        w = common.Words(b["text"])
        change = np.zeros(len(w.start) + 1, np.int64)
        cuts = b["cuts"]
        for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
            at = np.fromiter((x for c in cuts[i].as_py() for x in c), np.int64) + w.first[i]
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
        keep = np.cumsum(change)[:-1] <= 0
        kept = np.flatnonzero(keep)
        ends = w.end[kept].copy()
        more = np.flatnonzero(w.row[kept][1:] == w.row[kept][:-1])  # kept words that others of their text follow
        w.data[ends[more]] = 0x20  # a text has white space after such a word
        ends[more] += 1
        edge = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(edge, w.start[kept], 1)
        np.add.at(edge, ends, -1)
        left = w.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        size = np.bincount(w.row[kept], ends - w.start[kept], b.num_rows).astype(np.int64)
        place = np.append(0, np.cumsum(size))
        texts = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(place.astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())]).cast(pa.binary())
        n = np.diff(w.first)
        gone = n - np.bincount(w.row[kept], minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)), texts], ["doc_id", "n_words", "n_removed", "kept"])


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))


def _wanted(d: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, text_key, text and want of the texts that ranges (doc, text_key, key, ctx, pos, lo, hi, later, n) lie in; a list is bounded by its text."""
    want = ranges.groupBy("doc", "text_key").agg(F.collect_list(F.struct("key", "ctx", "pos", "lo", "hi", "later", "n")).alias("want"))
    return d.join(want, ["doc", "text_key"])


def _searched(d: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """The reports of the shards of n ranges; the ranges of one key share a shard."""
    pieces = _wanted(d, ranges).select("doc", "text", "want").mapInArrow(_cut_out, _PIECE)
    shards = max(1, -(-n // SHARD_CONTEXTS))
    return pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(search, _REPORT)


def reports(d: DataFrame, one: DataFrame) -> DataFrame:
    """(key, ctx, n, ats, firsts) of distinct contexts (key, ctx, doc, text_key, pos, lo, hi, later, n)."""
    total = one.count()
    hot_keys = common.cut(one.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT), "hot")
    if hot_keys.isEmpty():
        return _searched(d, one, total)
    hot, plain = common.skewed_split(one, hot_keys, ["key"], "m")
    w = _wanted(d, hot).select("doc", "text_key", "text", "want")
    w = w.mapInArrow(_slices, "key long, ctx long, doc long, text_key long, at int, lo int, core long, hashes array<long>, later boolean, n long")
    w = common.cut(w, "slices")
    live = w.groupBy("core").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.bool_or("later").alias("l"), F.count("*").alias("m")).where("l or a < b")
    w = common.skewed_join(w, common.cut(live.select("core", "m"), "live"), ["core"], "m")
    w = w.select("key", "ctx", "doc", "text_key", "at", "lo", "later", "n", F.posexplode("hashes").alias("i", "hash"))
    w = common.cut(w.selectExpr("key", "ctx", "doc", "text_key", "at + i as at", "lo + i as lo", "hash", "later", "n"), "windows")
    # a window counts if another document holds it, in its own context or in another one
    once = w.groupBy("hash").agg(F.min(F.struct("doc", "text_key", "lo")).alias("o"), F.max("doc").alias("last"), F.bool_or("later").alias("later"), F.count("*").alias("m"))
    once = common.cut(once.where("later or o.doc < last").select("hash", "o.*", "m"), "distinct_windows")
    ranges = once.selectExpr("doc", "text_key", "hash as key", "0L as ctx", "lo as pos", "lo", f"lo + {WINDOW} as hi", "true as later", "m as n")
    first = _searched(d, ranges, once.count()).select(F.col("key").alias("hash"), F.array_min("firsts").alias("first"), F.col("n").alias("m"))
    found = common.skewed_join(w, common.cut(first, "first_windows"), ["hash"], "m")
    found = found.groupBy("key", "ctx").agg(F.max("n").alias("n"), F.collect_list(F.struct("at", "first")).alias("x"))
    return _searched(d, plain, total).unionByName(found.select("key", "ctx", "n", F.col("x.at").alias("ats"), F.col("x.first").alias("firsts")))


def intervals(docs: DataFrame) -> DataFrame:
    """(doc, text_key, cuts): starts of removed windows of each document that loses any, as lists."""
    d = _docs(docs)
    occ = common.cut(d.mapInArrow(_occurrences, "key long, ctx long, doc long, text_key long, pos int, lo int, hi int"), "anchors")
    # anchors of two documents or more
    shared = occ.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n")
    occ = common.cut(common.skewed_join(occ, common.cut(shared, "shared"), ["key"], "n"), "occurrences")
    # one occurrence of each distinct context, in its earliest document
    one = occ.groupBy("key", "ctx").agg(F.min(F.struct("doc", "text_key", "pos", "lo", "hi")).alias("o"), F.max("doc").alias("last"), F.count("*").alias("n"))
    one = common.cut(one.select("key", "ctx", "o.*", (F.col("o.doc") < F.col("last")).alias("later"), "n"), "contexts")
    found = common.cut(reports(d, one), "found")
    back = common.skewed_join(occ, found, ["key", "ctx"], "n")
    gone = F.expr("transform(filter(arrays_zip(ats, firsts), x -> x.firsts < doc), x -> x.ats + lo)")
    back = back.select("doc", "text_key", gone.alias("c")).where("size(c) > 0")
    return back.groupBy("doc", "text_key").agg(F.collect_list("c").alias("cuts"))  # bounded by the document


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "text_key": F.xxhash64("text")})
    out = src.join(intervals(docs), ["doc", "text_key"], "left").select("doc_id", "text", "cuts")
    return out.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
