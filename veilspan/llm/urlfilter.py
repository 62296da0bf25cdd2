"""URL filters: allow and block rules, then gradient-boosted trees for URLs that no rule fits.

Host and path are cut out with SQL functions. Rules are pairs of host and path (`net/` is host
`net`, path `/`); a rule fits its host and all subdomains when the URL's path starts with the
rule's, and the longest fitting rule wins. All other URLs are judged by shallow regression trees,
boosted on the logistic loss over lexical features: lengths, depth, digit ratio, entropy,
parameter counts and the block rates of the host's suffixes (two and three labels). They learn from
labelled URLs: a table that the caller has, or URLs labelled by what their pages hold
(`by_page_content`), or else URLs labelled by words of ill repute among the words of their host
(`by_host_words`). The rules label nothing. A bounded sample of the labelled URLs whose
crc32 modulo 4 is not 2 trains; the others are held out.

Nulls: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged
on its (empty) features; a null page is an empty one. Very long URLs and pages are read whole.
Repeated rows are judged alike, ties between rules of one length go to
the alphabetically first, and without labels of both kinds every URL is allowed (or blocked, if
all labels say so). Columns other than page_id and url are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_PAGE_WORDS, MAX_SYMBOLS, MIN_DISTINCT, MAX_LINKS = 20, 0.1, 0.2, 0.5  # by_page_content: words of a page, and shares of its words
# host words that mark a URL as an example to block; a caller's labels take their place
ILL_WORDS = ["casino", "bets", "betting", "poker", "pills", "viagra", "porn", "xxx", "payday", "loans", "replica", "warez", "cheap", "win"]
SAMPLE_URLS = 4000  # labelled URLs to learn from, at most
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 3, 0.2, 32, 8
SMOOTH = 20.0  # prior rows of a suffix's block rate
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (both null if none does)."""
    name = verdict = None
    for rule, judged in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(judged)) if verdict is None else verdict.when(fits, F.lit(judged))
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def suffixes(host: str) -> tuple[str, str]:
    """The last two and the last three labels of a host, told apart by a leading digit."""
    labels = host.split(".")
    return "2" + ".".join(labels[-2:]), "3" + ".".join(labels[-3:])


def features(url: str, host: str, path: str) -> list[float]:
    """Lexical features of one URL (the suffix statistics are appended by the model)."""
    n = len(url)
    query = url.partition("?")[2].partition("#")[0]
    count = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0
    digits = sum(c.isdigit() for c in url)
    return [
        n, len(host), len(path), path.count("/"), host.count("."), digits / n if n else 0.0, entropy,
        query.count("=") , query.count("&") + bool(query), len(query), host.count("-"), sum(c.isdigit() for c in host),
        url.count("%"), float(url.startswith("https")), max(map(len, host.split("."))), float("#" in url),
    ]


@dataclass
class Boosted:
    """Regression trees of fixed depth kept as arrays: node i has the children 2i+1 and 2i+2."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    rates: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    def matrix(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([[*features(*r), *(self.rates.get(s, self.prior) for s in suffixes(r[1]))] for r in rows], float).reshape(len(rows), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feat[node]] > cut[node])
            total += RATE * leaf[node - len(feat)]
        return 1 / (1 + np.exp(-total))


def train(rows: list[tuple[str, str, str]], y: list[int]) -> Boosted:
    """Fit on (url, host, path) rows and 0/1 labels (1: block)."""
    m = Boosted()
    y_ = np.array(y, float)
    if not len(y_) or y_.min() == y_.max():
        m.base = 5.0 if len(y_) and y_[0] else -5.0
        return m
    m.prior = float(y_.mean())
    total: Counter[str] = Counter()
    block: Counter[str] = Counter()
    for (_, h, _), v in zip(rows, y, strict=True):
        for s in suffixes(h):
            total[s] += 1
            block[s] += v
    m.rates = {s: (block[s] + SMOOTH * m.prior) / (n + SMOOTH) for s, n in total.items()}
    x = m.matrix(rows)
    # a training row's own label must not reach its suffix statistics
    x[:, -2:] = [[(block[s] - v + SMOOTH * m.prior) / (total[s] - 1 + SMOOTH) for s in suffixes(h)] for (_, h, _), v in zip(rows, y, strict=True)]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    m.base = math.log(m.prior / (1 - m.prior))
    f = np.full(len(y_), m.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y_ - p, p * (1 - p)
        feat, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y_), int)
        for i in range(inner):
            own_rows = np.flatnonzero(node == i)
            best = (1e-9, 0, math.inf, 0)
            if len(own_rows) >= 2 * MIN_LEAF:
                gs, hs = g[own_rows].sum(), h[own_rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[own_rows, j]
                    gl = np.cumsum(np.bincount(b, g[own_rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[own_rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < MIN_LEAF) | (len(b) - nl < MIN_LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, c[k], k)
            feat[i], cut[i] = best[1], best[2]
            right = np.zeros(len(own_rows), int) if math.isinf(best[2]) else (binned[own_rows, best[1]] > best[3]).astype(int)
            node[own_rows] = 2 * i + 1 + right
        leaf = np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1)
        m.trees.append((feat, cut, leaf))
        f += RATE * leaf[node - inner]
    return m


def parts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    src = src.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return src.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def by_host_words(pages: DataFrame, words: list[str] = ILL_WORDS) -> DataFrame:
    """(url, verdict): block for URLs with one of the words in their host, allow for the others; URLs without a host have no label."""
    url = F.col("url").cast("string")
    ill = F.arrays_overlap(F.split(host_of(url), "[^a-z0-9]+"), F.array(*map(F.lit, words)))
    return pages.where(host_of(url) != "").select(url.alias("url"), F.when(ill, "block").otherwise("allow").alias("verdict"))


def by_page_content(pages: DataFrame) -> DataFrame:
    """(url, verdict) from a page's html alone: block for pages with hardly any text, or full of symbols, repeated words or links.

    Words are counted outside tags, scripts, styles and comments. No part of the URL is looked at (but those without a host have no label), so that what the
    trees find in URLs is not what labelled them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    page = pages.where(host_of(F.col("url").cast("string")) != "").select(
        F.col("url").cast("string").alias("url"), F.regexp_count(html, F.lit(r"(?i)<a\s")).alias("links"), F.regexp_replace(text, "<[^>]*>", " ").alias("text")
    )
    page = page.select("url", "links", F.expr(r"filter(split(text, '[ \t-\r]+'), w -> w <> '')").alias("w"), F.regexp_count("text", F.lit("[#*$%|<>]")).alias("symbols"))
    n = F.size("w")
    ill = (n < MIN_PAGE_WORDS) | (F.col("symbols") > MAX_SYMBOLS * n) | (F.size(F.array_distinct("w")) < MIN_DISTINCT * n) | (F.col("links") > MAX_LINKS * n)
    return page.select("url", F.when(ill, "block").otherwise("allow").alias("verdict"))


def held_out_report(pages: DataFrame, labelled: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row: held-out labelled URLs, those to block, those blocked, and those rightly blocked, over all pages' URLs with a label."""
    known = labelled.where("verdict in ('block', 'allow') and url is not null").select("url", F.col("verdict").alias("truth")).distinct()
    judged = judge(pages, [], model or fit(labelled)).select("page_id", "verdict")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).where(held_out(F.col("url")))
    both = own.join(judged, "page_id").select("url", "verdict").distinct().join(known, "url")
    hit = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ill, blocked = F.col("truth") == "block", F.col("verdict") == "block"
    return both.agg(F.count("*").alias("urls"), hit(ill).alias("to_block"), hit(blocked).alias("blocked"), hit(ill & blocked).alias("rightly"))


def held_out(url: Column) -> Column:
    return F.pmod(F.crc32(url.cast("binary")), F.lit(4)) == 2


def fit(labelled: DataFrame, sample_urls: int = SAMPLE_URLS) -> Boosted:
    """Learn from at most sample_urls rows (url, verdict) that are not held out, chosen by a hash of the url; equal rows count once."""
    known = labelled.where("verdict in ('block', 'allow') and url is not null").where(~held_out(F.col("url"))).select("url", "verdict")
    got = common.sample(known, "url", sample_urls, 3).distinct().select("url", "verdict", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    got = got.orderBy("url", "verdict").collect()
    return train([(r["url"], r["host"], r["path"]) for r in got], [int(r["verdict"] == "block") for r in got])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: Boosted | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides)."""
    p = parts(pages, rules)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(by_host_words(pages)))  # TREES small trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = b["rule"].isna().to_numpy()
            score = np.full(len(b), np.nan)
            if todo.any():
                own = b.loc[todo, ["url", "host", "path"]].fillna("")
                score[todo] = shared.value.score(shared.value.matrix(list(own.itertuples(index=False, name=None))))
            verdict = b["verdict"].where(~todo, np.where(score >= 0.5, "block", "allow"))
            out = b[["page_id", "host", "path", "rule"]].assign(verdict=verdict)
            out["page_id"] = out["page_id"].astype("Int64")
            out["block_score"] = [None if math.isnan(s) else float(s) for s in score]
            yield out

    return p.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, block_score double")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
