"""BPE encoding and decoding, equal to the tokenizers library's, with tree concatenation.

A text of more than PIECE characters is cut into pieces, wherever the cut falls, and each piece is
encoded on its own, in tasks of their own. Neighbours are then joined, level by level: around each
join a window is encoded anew and grown until both sides agree exactly. White space separates
tokens for certain, so a window that has reached white space on both sides agrees; a join inside a
long run of letters agrees sooner: a sequence of tokens is the encoding of its text if and only if
each pair of neighbours is the encoding of its own text, so that only the two pairs at the window's
ends have to be tested. Words of more than LONG letters go the same way inside a task. Shorter
units between white space and the vocabulary's pre-tokens are remembered by each worker.

Nulls: null text is empty: no tokens, empty decoded text. Repeated rows are encoded alike; empty
tables give empty results; only doc_id, text and the carried columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

PIECE = 8192  # a longer text is cut into pieces of so many characters
LONG = 24  # a word of more bytes is encoded by tree concatenation
WINDOW = 4  # tokens on each side of a join to start with
CACHE, CACHED_CHARS = 150_000, 512  # chunks that a worker remembers, and the longest of them
# Latin-1 characters that rule the fast path out: separators that only Python takes for white
# space, digits that only the library takes for numbers, and the start of a special token
_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|<\\|")
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


_WHITE = re.compile("[\t-\r ]")
_LETTERS = re.compile("[A-Za-z]+")
NEAR = 24  # letters on each side of a join that rule out contractions, special tokens and composed characters


@dataclass
class Piece:
    """Ids of a piece as bytes, its first and last words, and whether white space lies between them."""

    ids: bytes
    head: str
    tail: str
    split: bool


class Coder:
    """One vocabulary: library objects plus ranked merges for the partial encodings."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.tokens = [""] * (max(max(self.vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for t, i in self.vocab.items():
            self.tokens[i] = t
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.final = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.tokens])
        self.cache: dict[str, bytes] = {}

    # -- one word, as the list of its byte symbols -------------------------------------------
    def symbols(self, word: str) -> list[str]:
        """The symbols of a pre-token; the last carries the end-of-word suffix."""
        return [*word[:-1], word[-1] + self.suffix]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked, then leftmost pair is joined until none is left."""
        n = len(parts)
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def split_token(self, token: str) -> list[str]:
        """The symbols of a token."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.symbols(token[: -len(self.suffix)])
        return list(token)

    def agree(self, a: str, b: str) -> bool:
        """Whether the text of two neighbours is encoded as just these two."""
        return self.merge(self.split_token(a) + self.split_token(b)) == [a, b]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of the joined text of two encodings of parts of one word."""
        k = WINDOW
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            mid = self.merge([s for t in left[a:] + right[:b] for s in self.split_token(t)])
            if (a == 0 or self.agree(left[a - 1], mid[0])) and (b == len(right) or self.agree(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            k *= 2

    def tree(self, parts: list[str]) -> list[str]:
        """Encode a long word's symbols: leaves on their own, then joins level by level."""
        level = [self.merge(parts[i : i + LONG]) for i in range(0, len(parts), LONG)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    # -- texts -------------------------------------------------------------------------------
    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def long_chunk(self, chunk: str) -> bytes:
        """A long chunk without white space: the library normalises and splits it, long words go through the tree."""
        ids: list[int] = []
        for piece in regex.split(r"(<\|startoftext\|>|<\|endoftext\|>)", chunk):
            if piece in ("<|startoftext|>", "<|endoftext|>"):
                ids.append(self.lib.token_to_id(piece))
            elif piece:
                for word, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(piece)):
                    s = self.symbols(word)
                    ids += [self.vocab[t] for t in (self.tree(s) if len(s) > LONG else self.merge(s))]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        try:
            text.encode("latin-1")
            plain = _PLAIN.search(text) is None
        except UnicodeEncodeError:
            plain = False
        if plain:  # lower-casing and pre-tokens are those of the library for these characters
            units, fill = _UNIT.findall(text.lower()), self.fill_words
        else:
            # chunks between white space; str.split() would also split at U+001C to U+001F
            units, fill = [c for c in _SPACE.split(text) if c], self.fill_chunks
        cache = self.cache
        try:
            return b"".join([cache[u] for u in units])
        except KeyError:
            pass
        new = {u for u in units if u not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set(units)
        long = {u: self.long_chunk(u) for u in new if len(u) > LONG}
        fill([u for u in new if len(u) <= LONG])
        out = b"".join([cache[u] if u in cache else long[u] for u in units])
        cache.update((u, e) for u, e in long.items() if len(u) <= CACHED_CHARS)
        return out

    def fill_words(self, words: list[str]) -> None:
        """Encode single pre-tokens together: each ends with the one token that has the suffix."""
        if not words:
            return
        ids = np.array(self.lib.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        raw, start = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self.cache[w] = raw[start:end]
            start = end

    def fill_chunks(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.lib.encode_batch(chunks, add_special_tokens=False), strict=True):
            self.cache[c] = np.array(e.ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    # -- pieces ------------------------------------------------------------------------------
    def piece(self, text: str) -> Piece:
        """A piece of a text, encoded on its own; head and tail are what lies outside its first and last white space."""
        first, last = _WHITE.search(text), max(map(text.rfind, " \t\n\v\f\r"))
        if not first:
            return Piece(self.encode(text), text, text, False)
        return Piece(self.encode(text), text[: first.start()], text[last + 1 :], True)

    def joined(self, a: Piece, b: Piece) -> Piece:
        """The encoding of two neighbours from their own encodings."""
        head = a.head if a.split else a.head + b.head
        tail = b.tail if b.split else a.tail + b.tail
        ids = self.inside_word(a, b) if a.tail and b.head else a.ids + b.ids
        if ids is None:  # the window reaches white space on both sides
            left, right = len(self.encode(a.tail)), len(self.encode(b.head))
            ids = a.ids[: len(a.ids) - left] + self.encode(a.tail + b.head) + b.ids[right:]
        return Piece(ids, head, tail, a.split or b.split)

    def inside_word(self, a: Piece, b: Piece) -> bytes | None:
        """The join inside a run of letters, by pairs of tokens; None where other characters are near."""
        if not (_LETTERS.fullmatch(a.tail[-NEAR:]) and _LETTERS.fullmatch(b.head[:NEAR])) or min(len(a.tail), len(b.head)) < NEAR:
            return None
        left, right = np.frombuffer(a.ids, "<u4"), np.frombuffer(b.ids, "<u4")
        k = WINDOW
        while True:
            lo = self.tokens_back(left, k)
            hi = self.tokens_on(right, k)
            before, after = (list(map(self.tokens.__getitem__, x.tolist())) for x in (left[lo:], right[:hi]))
            before[-1] = before[-1].removesuffix(self.suffix)  # the word goes on
            middle = self.merge([s for t in before + after for s in self.split_token(t)])
            opens = lo == 0 or bool(self.final[left[lo - 1]])
            closes = bool(self.final[right[hi - 1]])
            if (opens or self.agree(self.tokens[left[lo - 1]], middle[0])) and (closes or self.agree(middle[-1], self.tokens[right[hi]])):
                return a.ids[: 4 * lo] + np.array([self.vocab[t] for t in middle], "<u4").tobytes() + b.ids[4 * hi :]
            k *= 2

    def tokens_back(self, ids: np.ndarray, k: int) -> int:
        """The place k tokens before the end, or where the last word begins if that is nearer."""
        ends = np.flatnonzero(self.final[ids[max(0, len(ids) - 1 - k) : -1]])
        return max(0, len(ids) - 1 - k) + int(ends[-1]) + 1 if len(ends) else max(0, len(ids) - k)

    def tokens_on(self, ids: np.ndarray, k: int) -> int:
        """The number of tokens to the k-th, or to the end of the first word if that is nearer."""
        ends = np.flatnonzero(self.final[ids[:k]])
        return int(ends[0]) + 1 if len(ends) else min(k, len(ids))

    def concatenated(self, pieces: list[Piece]) -> bytes:
        while len(pieces) > 1:
            pieces = [self.joined(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0].ids


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(docs: DataFrame, path: str | None, finish: Callable[[Coder, bytes], tuple], columns: str, carried: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the carried columns (name: type) and what finish makes of the ids of each text."""
    path, carried = path or default_path(), carried or {}
    keys = ["doc_id", *carried]
    names = [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join(["doc_id long", *[f"{c} {t}" for c, t in carried.items()], columns])

    def rows(b: pd.DataFrame, ids: list[bytes]) -> pd.DataFrame:
        made = [finish(coder(path), x) for x in ids]
        out = b[keys].reset_index(drop=True).astype({"doc_id": "Int64"} | {c: "Int64" for c, t in carried.items() if t == "long"})
        return out.assign(**{n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(names)})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(b, [coder(path).encode(t) for t in b["text"]])

    def piece(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [coder(path).piece(t) for t in b["piece"]]
            yield b.drop(columns="piece").assign(ids=[x.ids for x in p], head=[x.head for x in p], tail=[x.tail for x in p], split=[x.split for x in p]).astype({"doc_id": "Int64"} | {c: "Int64" for c, t in carried.items() if t == "long"})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: the pieces of one text follow each other; one text at a time is joined."""
        now, pieces, ids, heads = None, [], [], []

        def close() -> None:
            ids.extend([coder(path).concatenated(pieces)] * now[-1])
            heads.extend([now[: len(keys)]] * now[-1])

        for b in batches:
            own = b[keys].astype(object).where(b[keys].notna(), None)
            for key, text_key, copies, i, *x in zip(own.itertuples(index=False, name=None), b["text_key"], b["copies"], b["i"], b["ids"], b["head"], b["tail"], b["split"], strict=True):
                if i == 0:
                    if now:
                        close()
                    now, pieces = (*key, text_key, copies), []
                pieces.append(Piece(*x))
            if len(ids) >= 200:
                yield rows(pd.DataFrame(heads, columns=keys), ids)
                ids, heads = [], []
        if now:
            close()
        yield rows(pd.DataFrame(heads, columns=keys), ids)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast(t).alias(c) for c, t in carried.items()])
    long = F.coalesce(F.length("text") > PIECE, F.lit(False))
    cut = src.where(long).select(*keys, F.xxhash64("text").alias("text_key"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("i", "piece"))
    # pieces are dealt over the tasks one by one; repeated rows are encoded once
    cut = cut.groupBy(*keys, "text_key", "i").agg(F.first("piece").alias("piece"), F.count("*").alias("copies"))
    of = ", ".join(["doc_id long", *[f"{c} {t}" for c, t in carried.items()]])
    coded = cut.mapInPandas(piece, f"{of}, text_key long, i int, copies long, ids binary, head string, tail string, split boolean")
    coded = coded.repartition(*keys, "text_key").sortWithinPartitions(*keys, "text_key", "i")
    return src.where(~long).mapInPandas(short, schema).unionByName(coded.mapInPandas(join, schema))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of each document."""
    return _encoded(docs, path, lambda c, ids: (len(ids) // 4, ids), "n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of rows of encode_documents."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "decoded": [c.decode(np.frombuffer(x, "<u4")) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded string")


def _digest(c: Coder, ids: bytes) -> str:
    return hashlib.sha256(c.decode(np.frombuffer(ids, "<u4")).encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes in one pass."""
    return _encoded(docs, path, lambda c, ids: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), _digest(c, ids)), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_table(docs: DataFrame, path: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded_sha256 and carried long columns of each document: what a trainer reads."""
    columns = {"source": "string"} | {c: "long" for c in carried}
    out = _encoded(docs, path, lambda c, ids: (len(ids) // 4, np.frombuffer(ids, "<i4"), _digest(c, ids)), "n_tokens long, ids array<int>, decoded_sha256 string", columns)
    return out.select("doc_id", "source", "n_tokens", "ids", "decoded_sha256", *carried)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
