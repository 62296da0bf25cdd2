"""Recognisers that may fail: each document's failures become codes in its row, and the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Recogniser = Callable[[str], list[tuple[int, int, str, float]]]  # a text to (start, end, category, score)
VOTES = "array<struct<model:string,start:int,end:int,category:string,score:double>>"
ERRORS = "array<struct<model:string,code:string>>"


def code_of(error: BaseException) -> str:
    """What may be told of an error: its kind, never its message, as that may quote the text."""
    return type(error).__name__


def recognised(docs: DataFrame, models: dict[str, Recogniser | Callable[[], Recogniser]], load: bool = False) -> DataFrame:
    """(doc_id, votes, errors, failed) of documents (doc_id, text) by several models.

    A model that fails on a document is left out there, with an error code; failed: all models did.
    load: the values of `models` make a recogniser, once per task; one that cannot be made fails on
    all documents of the task. Null texts have no votes and no errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Recogniser | str] = {}
        for name, m in models.items():
            try:
                ready[name] = m() if load else m
            except Exception as e:  # noqa: BLE001
                ready[name] = code_of(e)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                votes, errors = [], []
                for name, m in ready.items() if text is not None else ():
                    try:
                        if isinstance(m, str):
                            errors.append({"model": name, "code": m})
                        else:
                            votes += [{"model": name, "start": s, "end": e, "category": c, "score": float(x)} for s, e, c, x in m(text)]
                    except Exception as e:  # noqa: BLE001
                        errors.append({"model": name, "code": code_of(e)})
                rows.append((doc, votes, errors, bool(models) and len(errors) == len(models)))
            yield pd.DataFrame(rows, columns=["doc_id", "votes", "errors", "failed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, votes {VOTES}, errors {ERRORS}, failed boolean")


def model_stage(docs: DataFrame, models: dict[str, Recogniser], load: bool = False) -> DataFrame:
    """(doc_id, candidates, failed, errors): the graded union of all models that did not fail, as `resolve.detect` takes it."""
    from veilspan.functions.spans import CANDIDATES
    from veilspan.operators import ner
    from veilspan.sources.shared import cut

    r = cut(recognised(docs, models, load), "recognised")  # models run once
    votes = r.select("doc_id", F.explode("votes").alias("v")).select("doc_id", "v.*")
    good = ner.graded(ner.clusters(votes), docs)
    one = F.struct("start", "end", "category", "confidence", F.lit("ner").alias("method"), F.lit("model").alias("rule"))
    found = good.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).cast(CANDIDATES).alias("candidates"))
    return r.select("doc_id", "failed", "errors").join(found, "doc_id", "left").select("doc_id", F.coalesce("candidates", F.expr(f"cast(array() as {CANDIDATES})")).alias("candidates"), "failed", "errors")
