"""The stream guard: no answer may point outside its sources, checked while it is written.

``guard`` is the batch form over whole attempts, built-in functions only;
``guard_stream`` is the streaming form with state by attempt. Both give the same
text, holes and verdict for the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How a hole is written, what may still become one, and the two states.
HOLE = r"\[\[REF:(\d+)\]\]"
PARTIAL = r"\[(\[(R(E(F(:(\d*)?)?)?)?)?)?\z|\[\[REF:\d+\]\z"
OPEN, RETRACTED = "abierto", "retractado"
_HOLE = re.compile(HOLE)
_PARTIAL = re.compile(r"\[(\[(R(E(F(:(\d*)?)?)?)?)?)?\Z|\[\[REF:\d+\]\Z")


def guarded(text: Column, n_sources: Column) -> Column:
    """struct(emitted, holes, state, pending) after all of an attempt's text.

    Text goes out up to the first hole outside 1..n_sources, which retracts the
    attempt; else up to what may still become a hole, which is pending.
    """
    numbers = F.transform(F.regexp_extract_all(text, F.lit(HOLE), F.lit(1)), lambda n: n.try_cast("bigint"))
    fits = lambda n: F.coalesce(n.between(1, n_sources), F.lit(False))
    bad = F.array_position(F.transform(numbers, fits), False).cast("int")
    parts = F.split(text, HOLE, -1)
    whole = F.regexp_extract_all(text, F.lit(HOLE), F.lit(0))
    # What stands before the first bad hole: the parts and holes before it, one after another.
    before = F.array_join(F.transform(F.sequence(F.lit(1), bad), lambda i: F.concat(F.get(parts, i - 1), F.when(i < bad, F.get(whole, i - 1)).otherwise(""))), "")
    held = F.regexp_extract(text, f"({PARTIAL})", 1)
    out = F.when(bad > 0, before).otherwise(F.substring(text, F.lit(1), F.length(text) - F.length(held)))
    return F.struct(out.alias("emitted"), F.when(bad > 0, F.slice(numbers, F.lit(1), bad - 1)).otherwise(numbers).cast("array<int>").alias("holes"), F.when(bad > 0, RETRACTED).otherwise(OPEN).alias("state"), F.when(bad > 0, "").otherwise(held).alias("pending"))


def guard(tokens: DataFrame) -> DataFrame:
    """request_id, attempt, emitted, holes, state from (request_id, attempt, seq, token, n_sources). An attempt is one row of one task."""
    joined = tokens.groupBy("request_id", "attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda t: t["token"]), "").alias("text"), F.max("n_sources").alias("n_sources"))
    g = guarded(F.col("text"), F.col("n_sources"))
    return joined.withColumn("g", g).select("request_id", "attempt", "g.emitted", "g.holes", "g.state")


class Guard:
    """The same for one attempt, token by token."""

    def __init__(self, n_sources: int, state: str = OPEN, buffer: str = "") -> None:
        self.n_sources, self.state, self.buffer = n_sources, state, buffer

    def take(self, token: str) -> tuple[str, list[int]]:
        """What may go out now, and the holes in it."""
        if self.state == RETRACTED:
            return "", []
        self.buffer += token
        out, holes, at = [], [], 0
        for m in _HOLE.finditer(self.buffer):
            n = int(m[1])
            if not 1 <= n <= self.n_sources:
                out.append(self.buffer[at : m.start()])
                self.state, self.buffer = RETRACTED, ""
                return "".join(out), holes
            holes.append(n)
            out.append(self.buffer[at : m.end()])
            at = m.end()
        rest = self.buffer[at:]
        p = _PARTIAL.search(rest)
        keep = p.start() if p else len(rest)
        out.append(rest[:keep])
        self.buffer = rest[keep:]
        return "".join(out), holes


_FIELDS = {"request_id": T.StringType(), "attempt": T.IntegerType(), "seq": T.LongType(), "text": T.StringType(), "holes": T.ArrayType(T.IntegerType()), "state": T.StringType(), "done": T.BooleanType()}
PIECES = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS.items()])


class _GuardProcessor(StatefulProcessor):
    """State by attempt: what is buffered, and tokens that came before their turn (order is not kept across micro-batches).

    An attempt that is over leaves a mark, so that its tokens aren't taken again;
    marks, and attempts that nothing comes for, go after ``keep_ms``.
    """

    def __init__(self, keep_ms: int, whole: bool = False) -> None:
        self.keep_ms, self.whole = keep_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "text string", self.keep_ms) if self.whole else None
        self.at = handle.getValueState("at", "next bigint, state string, buffer string, n_sources int, over boolean", self.keep_ms)
        self.early = handle.getMapState("early", "seq bigint", "token string, is_last boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        request, attempt = key
        known = self.at.get() if self.at.exists() else None
        if known and known[4]:
            for _ in rows:  # what comes after the end
                pass
            return
        turn, n = (known[0] if known else 0), (known[3] if known else None)
        for batch in rows:
            for seq, token, last, sources in zip(batch["seq"], batch["token"], batch["is_last"], batch["n_sources"]):
                n = int(sources) if n is None else n
                if seq >= turn:
                    self.early.updateValue((int(seq),), (token or "", bool(last)))
        g = Guard(n or 0, known[1] if known else OPEN, known[2] if known else "")
        out, over = [], False
        while not over and self.early.containsKey((turn,)):
            token, last = self.early.getValue((turn,))
            self.early.removeKey((turn,))
            text, holes = g.take(token)
            over = bool(last) or g.state == RETRACTED
            if self.whole and text:
                self.said.appendValue((text,))
            if text or holes or over:
                whole = ("".join(t for (t,) in self.said.get()) if over else None,) if self.whole else ()
                out.append((request, attempt, turn, text, holes, g.state, over, *whole))
            turn += 1
        if over:
            self.early.clear()
            if self.whole:
                self.said.clear()
        self.at.update((turn, g.state, "" if over else g.buffer, n or 0, over))
        if out:
            yield pd.DataFrame(out, columns=[*PIECES.names, "emitted"] if self.whole else PIECES.names)

    def close(self) -> None:
        pass


def guard_stream(tokens: DataFrame, keep_ms: int = 24 * 3600 * 1000, whole: bool = False) -> DataFrame:
    """Pieces that may be shown, as tokens come: (request_id, attempt, seq, token, n_sources, is_last) in any order.

    ``seq`` counts from 0 in each attempt; a piece goes out once all before it have
    come. ``done`` marks the last one: the attempt's end, or its retraction. What is
    held back when an attempt ends is dropped, and its state but for a mark, which
    goes after ``keep_ms``. With ``whole`` the last piece has all that the attempt
    has let out as emitted. The session needs the RocksDB state store.
    """
    fields = T.StructType([*PIECES.fields, T.StructField("emitted", T.StringType())]) if whole else PIECES
    return tokens.groupBy("request_id", "attempt").transformWithStateInPandas(statefulProcessor=_GuardProcessor(keep_ms, whole), outputStructType=fields, outputMode="Append", timeMode="ProcessingTime")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """An extension: counts by event-time window with a watermark, for streams and tables alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def serve_stream(pieces: DataFrame) -> DataFrame:
    """Of a batch of guarded pieces: request_id, attempt, emitted, state, done — what the verification takes."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy("request_id", "attempt").agg(text.alias("emitted"), F.max(F.struct("seq", "state"))["state"].alias("state"), F.bool_or("done").alias("done"))
