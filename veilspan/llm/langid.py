"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every word is its hashed character bigrams and trigrams, and its first and last four letters; a text is the average of their embeddings over
the whole text. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled documents. Because the average is linear, each word adds a
fixed vector of logits, so that prediction is one lookup per distinct word of a text.
Probabilities are calibrated by a temperature, and a rejection threshold is set, on part of the
sample that the training does not see.

Nulls: null text, or text without a letter, is `und` with score 0. Null lang rows are not learned
from. Ties between languages go to the alphabetically first. With no labelled row at all, every
document is `und`. Repeated rows are predicted alike; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

SAMPLE_DOCS = 3000  # labelled documents to learn from, at most
SAMPLE_CHARS = 20_000  # longer documents are not sampled (all are predicted)
BUCKETS, DIM, EPOCHS, RATE, REJECT_ERROR = 1 << 14, 16, 6, 0.5, 0.01
WORDS = 150_000  # words that a worker remembers


class Grams(dict):
    """The bucket of each n-gram, remembered up to a fixed number."""

    def __missing__(self, gram: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[gram] = out = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        return out


_GRAMS = Grams()


def features(word: str) -> list[int]:
    """Hashed character bigrams and trigrams of a word with its boundaries, and its ends of four."""
    w = f"<{word}>"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    grams += [w[i : i + 2] for i in range(1, len(w) - 2)]
    grams += [w[:5], w[-5:]]
    return [_GRAMS[g] for g in grams]


ENDS = "0123456789.,;:!?()[]{}<>#*$%&|\"'`~@^+=/\\_-"


def tokens(text: str) -> Counter[str]:
    """How often each lower-cased word occurs, with everything but letters cut off its ends."""
    out: Counter[str] = Counter()
    for w, n in Counter(text.lower().split()).items():
        if not w.isalpha():
            w = w.strip(ENDS)
        if w:
            out[w] += n
    return out


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x languages: embeddings times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self) -> None:
        self.words: dict[str, int] = {}  # place of a word in table
        self.table = np.zeros((WORDS, len(self.langs) + 1))  # its summed logits and number of features

    def learn(self, new: list[str]) -> None:
        """Enter words into the table."""
        grams = [features(w) for w in new]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.fromiter((g for f in grams for g in f), np.int64, int(sizes.sum()))
        at = len(self.words)
        self.table[at : at + len(new), :-1] = np.add.reduceat(self.logits[flat], np.cumsum(sizes) - sizes)
        self.table[at : at + len(new), -1] = sizes
        self.words.update(zip(new, range(at, at + len(new)), strict=True))

    def total(self, count: Counter[str]) -> np.ndarray:
        """Logits and number of features, summed over all words; texts with very many words go in portions."""
        out = np.zeros(len(self.langs) + 1)
        every = list(count)
        for i in range(0, len(every), WORDS // 2):
            part = every[i : i + WORDS // 2]
            new = [w for w in part if w not in self.words]
            if len(self.words) + len(new) > WORDS:
                self.words.clear()
                new = part
            if new:
                self.learn(new)
            own = np.fromiter(map(self.words.__getitem__, part), np.int64, len(part))
            out += np.fromiter(map(count.__getitem__, part), float, len(part)) @ self.table[own]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not common.has_letter(text):
            return "und", 0.0, True
        total = self.total(tokens(text))
        z = (total[:-1] / max(total[-1], 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, lang) rows; one row in five sets temperature and threshold."""
    rows = [(t, y) for t, y in rows if t and common.has_letter(t)]
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    memo: dict[str, list[int]] = {}
    data = []
    for t, y in rows:
        c: Counter[int] = Counter()
        for w, n in tokens(t).items():
            if w not in memo:
                memo[w] = features(w)
            for f in memo[w]:
                c[f] += n
        if c:
            ids, n = np.fromiter(c.keys(), np.int64), np.fromiter(c.values(), float)
            data.append((ids, n / n.sum(), langs.index(y)))
    order = rng.permutation(len(data))
    held = set(order[: len(data) // 5].tolist()) if len(data) >= 50 else set()
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = rng.normal(0, 1 / DIM, (DIM, len(langs)))
    bias = np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) * 10
        for i in rng.permutation(len(data)):
            if i in held:
                continue
            ids, n, y = data[i]
            x = n @ emb[ids]
            z = x @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            gx = out @ g
            out -= rate * 0.1 * np.outer(x, g)
            bias -= rate * 0.01 * g
            emb[ids] -= rate * n[:, None] * gx
    zs = np.array([data[i][1] @ emb[data[i][0]] @ out + bias for i in held]).reshape(-1, len(langs))
    ys = np.array([data[i][2] for i in held], int)

    def probs(t: float) -> np.ndarray:
        z = zs / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temperature, threshold = 1.0, 0.0
    if len(ys):
        grid = np.geomspace(0.2, 5, 25)
        temperature = float(min(grid, key=lambda t: -np.log(probs(t)[np.arange(len(ys)), ys] + 1e-12).mean()))
        p = probs(temperature)
        top, right = p.max(1), p.argmax(1) == ys
        cuts = np.sort(np.append(top, 0.0))
        ok = [c for c in cuts if (~right[top >= c]).mean() <= REJECT_ERROR]
        threshold = float(ok[0]) if ok else float(cuts[-1])
    return Model(langs, emb @ out, bias, temperature, threshold)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most sample_docs rows that are not held out, chosen by a hash of their id."""
    pool = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    pick = common.sample(pool.select("doc_id", "text", "lang"), "doc_id", sample_docs, 11)
    pick = pick.where(F.length("text") <= sample_chars)
    return train([(r["text"], r["lang"]) for r in pick.select("text", "lang").collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": [g[0] for g in got],
                 "score": [g[1] for g in got], "rejected": [g[2] for g in got]}
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return src.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
