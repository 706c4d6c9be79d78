"""Serving as a stream: relevance gate, guarded pieces, retraction, next attempt, result.

Tokens of all attempts may come in any order and at any time. The guard (state by
attempt) turns them into pieces; an attempt's last piece carries its draft, which is
parsed and verified in the row; the course (state by request) lets an attempt's pieces
out only when the one before has been judged and is to be retried, and gives each
request one result. A timer ends a request for which nothing comes any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import citations as C
from ..operators.verification import verify_rows
from .guard import RETRACTED, guard_stream

PIECE, RETRACT, RESULT = "piece", "retract", "result"
_OUT = {"request_id": T.StringType(), "kind": T.StringType(), "attempt": T.IntegerType(), "seq": T.LongType(), "text": T.StringType(), "salida": T.StringType(), "reintentos": T.IntegerType(), "refs": T.ArrayType(T.StringType()), "motivo": T.StringType(), "answer": T.StringType()}
SERVED = T.StructType([T.StructField(name, kind) for name, kind in _OUT.items()])
_HELD = "text string, retracted boolean, done boolean, out string, cannot boolean, refs array<string>, motivo string, answer string"


class _CourseProcessor(StatefulProcessor):
    """State by request: the attempt whose turn it is, and pieces of later ones. A request that is over leaves a mark, which goes after ``keep_ms``."""

    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "asked boolean, attempt int, over boolean, deadline bigint", self.keep_ms)
        self.held = handle.getMapState("held", "attempt int, seq bigint", _HELD, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        (request,) = key
        asked, attempt, over, deadline = self.at.get() if self.at.exists() else (False, 0, False, 0)
        out: list[tuple] = []
        for batch in rows:
            for r in batch.itertuples():
                if over:
                    continue
                if r.attempt < 0:
                    asked = True
                    if r.low:
                        over = True
                        out.append(self._result(request, C.ABSTAIN, 0, [], C.NOT_RELEVANT, None))
                elif r.attempt >= attempt:
                    text = lambda x: x if isinstance(x, str) else None
                    self.held.updateValue((int(r.attempt), int(r.seq)), (r.text or "", bool(r.retracted), bool(r.done), text(r.out), bool(r.cannot), [str(x) for x in r.refs] if r.refs is not None else [], text(r.motivo), text(r.answer)))
        while asked and not over:
            # Pieces of one attempt come with all before them, so what is here may go out.
            ready = sorted(seq for a, seq in self.held.keys() if a == attempt)
            judged = None
            for seq in ready:
                row = self.held.getValue((attempt, seq))
                self.held.removeKey((attempt, seq))
                if row[0]:
                    out.append((request, PIECE, attempt, seq, row[0], *[None] * 5))
                if row[1]:
                    out.append((request, RETRACT, attempt, seq, None, *[None] * 5))
                judged = row if row[2] else judged
            if judged is None:
                break
            _, _, _, decided, cannot, refs, motivo, answer = judged
            if cannot:
                over = True
                out.append(self._result(request, C.ABSTAIN, attempt, [], None, None))
            elif decided == C.RETRY:
                attempt += 1
            else:
                over = True
                answered = decided == C.ANSWER
                out.append(self._result(request, decided, attempt, list(refs) if answered else [], None if answered else motivo, answer if answered else None))
        if over:
            self.held.clear()
        deadline = self._timer(deadline, over, timers)
        self.at.update((asked, attempt, over, deadline))
        if out:
            yield pd.DataFrame(out, columns=SERVED.names)

    def _timer(self, deadline: int, over: bool, timers) -> int:
        """One timer a request: it is put off whenever something comes, and taken back at the end."""
        if deadline:
            self.handle.deleteTimer(deadline)
        if over:
            return 0
        deadline = timers.getCurrentProcessingTimeInMs() + self.wait_ms
        self.handle.registerTimer(deadline)
        return deadline

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (request,) = key
        asked, attempt, over, _ = self.at.get() if self.at.exists() else (False, 0, True, 0)
        if not over:
            self.held.clear()
            self.at.update((asked, attempt, True, 0))
            yield pd.DataFrame([self._result(request, C.ABSTAIN, attempt, [], C.NO_CITATIONS, None)], columns=SERVED.names)

    @staticmethod
    def _result(request: str, salida: str, attempt: int, refs: list[str], motivo: str | None, answer: str | None) -> tuple:
        return (request, RESULT, attempt, None, None, salida, attempt, refs, motivo, answer)

    def close(self) -> None:
        pass


def serve_requests_stream(asked: DataFrame, tokens: DataFrame, requests: DataFrame, wait_ms: int = 10 * 60 * 1000, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Pieces, retractions and results, as requests and tokens come; of the same tokens what ``serve_requests`` gives in batch.

    ``asked``: a stream of request_id (a string). ``tokens``: a stream of request_id, attempt,
    seq, token, n_sources, is_last, as for ``guard_stream``. ``requests``: a table of request_id, sources,
    relevance, in which a request stands before it is asked. A request whose sources are not relevant
    is answered at once, whatever its tokens; one that waits for ``wait_ms`` in vain is abstained.
    What comes for a request after its result changes nothing.
    """
    known = requests.select("request_id", "sources", "relevance", (F.size("sources") > 0).alias("has_sources"))
    pieces = guard_stream(tokens, keep_ms, whole=True).join(known, "request_id")
    parsed = pieces.withColumn("parts", C.split_draft(F.col("emitted"))).withColumn("citations", C.parse_citations(F.col("parts.lines"), F.col("sources")))
    cut = F.col("state") == RETRACTED
    told = verify_rows(parsed).withColumns({"ok": F.col("ok") & ~cut, "refs": F.when(~cut, F.col("refs")), "motivo": F.when(cut, C.OUT_OF_RANGE).otherwise(F.col("motivo"))})
    at_end = lambda c: F.when(F.col("done"), c)
    judged = told.select("request_id", "attempt", "seq", "text", cut.alias("retracted"), "done", at_end(C.decide(F.col("ok"), F.col("attempt"), F.col("has_sources"), F.lit(None).cast("double"))).alias("out"), at_end(C.says_cannot(F.col("emitted"))).alias("cannot"), at_end(F.col("refs")).alias("refs"), at_end(F.col("motivo")).alias("motivo"), at_end(F.col("parts.prose")).alias("answer"), F.lit(False).alias("low"))
    low = F.coalesce((F.col("relevance") < C.LEAST_RELEVANCE) & F.col("has_sources"), F.lit(False))
    none = {f.name: F.lit(None).cast(f.dataType) for f in judged.schema.fields}
    gate = asked.select("request_id").join(known, "request_id").select(*[{"request_id": F.col("request_id"), "attempt": F.lit(-1), "low": low, "seq": F.lit(-1).cast("bigint"), "retracted": F.lit(False), "done": F.lit(False), "cannot": F.lit(False)}.get(c, none[c]).alias(c) for c in judged.columns])
    judged = judged.withColumn("cannot", F.coalesce("cannot", F.lit(False)))
    return judged.unionByName(gate).groupBy("request_id").transformWithStateInPandas(statefulProcessor=_CourseProcessor(wait_ms, keep_ms), outputStructType=SERVED, outputMode="Append", timeMode="ProcessingTime")
