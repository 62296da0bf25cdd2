"""Detection and review over streams.

Rules and resolution need one row only, so they run on readStream as they are. Review commands are
folded per document with the items and the undo and redo stacks as state. Partial findings are
written per batch of segments, each batch to a folder of its own, and the final pass only adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan.operators import resolve
from veilspan.operators.review import History


def detect_stream(docs: DataFrame, rule_names: list[str] | None = None) -> DataFrame:
    """Findings of a streaming table of documents (doc_id, text); no state, no watermark."""
    return resolve.findings(resolve.detect(docs, rule_names))


def start(docs: DataFrame, path: str, checkpoint: str, rule_names: list[str] | None = None):
    """Append the findings of a stream to a parquet table, exactly once per input file."""
    out = detect_stream(docs, rule_names)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- history of a review -----------------------------------------------------------------------
class _Review(StatefulProcessor):
    """One document's history; its state is what `History` saves, and the last command's number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("history", "saved string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        saved, last = self.at.get() if self.at.exists() else (None, None)
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if last is not None:  # commands that the state already holds
            events = events[events["seq"] > last]
        h = History(saved)
        for op, k in zip(events["op"], events["key"], strict=True):
            h.apply(op, k)
        if len(events):
            last = int(events["seq"].iloc[-1])
            self.at.update((h.saved(), last))
        r = h.rows()
        yield pd.DataFrame({
            "doc_id": [int(key[0])] * max(1, len(r)), "seq": [last] * max(1, len(r)), "position": list(range(len(r))) or [-1],
            "key": [k for k, _, _ in r] or [None], "manual": [m for _, m, _ in r] or [None], "selected": [s for _, _, s in r] or [None],
        }).astype({"manual": "boolean", "selected": "boolean"})

    def close(self) -> None:
        pass


def review_stream(events: DataFrame) -> DataFrame:
    """The items of each document after every batch of commands (doc_id, seq, op, key), in update mode.

    Commands of a document arrive in the order of seq (within a batch in any order, repeats are
    ignored). Rows: (doc_id, seq of the last command, position, key, manual, selected); those of a
    document's largest seq hold, and one row with position -1 says that nothing is left. Needs the
    RocksDB state store.
    """
    schema = "doc_id long, seq long, position int, key string, manual boolean, selected boolean"
    return events.groupBy("doc_id").transformWithStateInPandas(_Review(), schema, "Update", "none")


def current(updates: DataFrame) -> DataFrame:
    """(doc_id, position, key, manual, selected): what holds of all updates so far."""
    last = updates.groupBy("doc_id").agg(F.max("seq").alias("seq"))
    return updates.join(last, ["doc_id", "seq"]).where("position >= 0").select("doc_id", "position", "key", "manual", "selected").distinct()


# --- partial results ---------------------------------------------------------------------------
def start_partial(segments: DataFrame, path: str, checkpoint: str, rule_names: list[str] | None = None):
    """Write the findings of a stream of segments (doc_id, at, text) as they come; a batch that is done again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        d = resolve.detect(batch.select(F.struct("doc_id", "at").alias("doc_id"), "text"), rule_names)
        f = resolve.findings(d).selectExpr("doc_id.doc_id", "start + doc_id.at as start", "end + doc_id.at as end", "category", "confidence", "method", "rule")
        f.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(partial: DataFrame, final: DataFrame) -> DataFrame:
    """Partial findings, each once, and the final ones that they lack: nothing that was shown is taken back."""
    keys = ["doc_id", "start", "end", "category"]
    shown = partial.select(*keys, "confidence", "method", "rule").dropDuplicates(keys)
    return shown.unionByName(final.select(*shown.columns).join(shown, keys, "left_anti"))
