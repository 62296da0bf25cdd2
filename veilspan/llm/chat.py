"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

A log has conv_id, seq, turn, kind, role, text. It is partitioned by conversation and sorted by
(turn, seq), and the events of one turn are folded in a single streaming pass:
`message` and `regenerate` start the turn's text anew, `delta` appends, `edit` replaces. So one
turn at a time is in memory, whatever the size of a conversation. Each final message is rendered
as a turn whose text has backslashes and control strings escaped reversibly.

Nulls: null text is empty, a null role is `user`, a null kind is `message`, null conv_id or turn
are values of their own (sorted first). Two messages with the same turn stay two messages, in the
order of seq, role and text. Empty logs give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

OPEN, CLOSE = "<turn ", "</turn>"
_SPECIAL = re.compile(r"\\|<(?=/?turn)|###")
_ESCAPED = re.compile(r"\\(b|l|h)")
_TO = {"\\": "\\b", "<": "\\l", "###": "\\h"}
_FROM = {"b": "\\", "l": "<", "h": "###"}
CONTROL = "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """No backslash, turn mark or `###` of the text survives unescaped."""
    return _SPECIAL.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[1]], text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace('>', chr(92) + 'g')}>\n{escape(text)}{CLOSE}\n"


_TURN = re.compile(rf"{OPEN}([^>]*)>\n(.*?){CLOSE}\n", re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end enclose the escaped text."""
    return [(unescape(m[1].replace("\\g", ">")), unescape(m[2]), *m.span(2)) for m in _TURN.finditer(formatted)]


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Where the assistant's texts lie in the formatted output."""
    return [(a, b) for role, _, a, b in parse(formatted) if role == "assistant"]


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, role, text) of each final message from sorted (conv_id, turn, kind, role, text)."""
    now: list | None = None
    for conv, turn, kind, role, text in events:
        if kind in ("delta", "edit", "regenerate") and now and now[0] == conv and now[1] == turn:
            if kind == "delta":
                now[3].append(text)
            else:
                now[3] = [text]
            continue
        if now:
            yield now[0], now[1], now[2], "".join(now[3])
        now = [conv, turn, role, [text]]
    if now:
        yield now[0], now[1], now[2], "".join(now[3])


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log of `message` events."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")


def _sorted(log: DataFrame) -> DataFrame:
    cols = [
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ]
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return log.select(*cols).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text", "kind")


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            conv = [None if pd.isna(c) else int(c) for c in b["conv_id"]]
            turn = [None if pd.isna(c) else int(c) for c in b["turn"]]
            yield from zip(conv, turn, b["kind"], b["role"], b["text"], strict=True)

    return fold(rows())


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read back each rendered turn and feed the digests of its conversation, turn by turn."""
    out: list[tuple] = []
    conv, state = None, None

    def close() -> None:
        n, turns, chars, loss, size = state
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for c, _, role, text in _messages(batches):
        if state is None or c != conv:
            if state is not None:
                close()
            conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        piece = render(role, text)
        state[4] += len(piece)
        for r, t, a, b in parse(piece):
            state[0] += 1
            state[1].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
            if r == "assistant":
                plain = unescape(piece[a:b])
                state[2] += len(plain)
                state[3].update(plain.encode("utf-8", "surrogatepass"))
        if len(out) >= 2000:
            yield _frame(out)
            out = []
    if state is not None:
        close()
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})


def digests(log: DataFrame) -> DataFrame:
    """One row per conversation, read back turn by turn from the rendered output."""
    return _sorted(log).mapInPandas(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def format_turns(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end: one row per final message, in order within a conversation.

    A conversation's formatted text is these pieces joined in order; they stay rows so that no
    single value holds a huge conversation. The loss mask is [loss_start, loss_end) of each piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for c, turn, role, text in _messages(batches):
            piece = render(role, text)
            a, b = next(iter(loss_spans(piece)), (0, 0))
            rows.append((c, turn, role, piece, a, b))
            size += len(piece)
            if len(rows) >= 5000 or size > 1 << 25:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return _sorted(log).mapInPandas(run, "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = as_log(common.read(spark, sf_dir, "conversations"))
    extra = spark.createDataFrame(
        [(-7, 0, 0, "message", "user", CONTROL), (-7, 1, 0, "message", "assistant", CONTROL)],
        "conv_id long, turn long, seq int, kind string, role string, text string",
    )
    return digests(log.unionByName(extra))
