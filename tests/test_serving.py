"""Serving: the stream against the batch, cancelled token streams, and a client's reading of events."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import citations as C
from lexweave.operators import verification
from lexweave.streaming import serve

SOURCES = [("N-1/2000#art1", "Los vehículos llevarán siempre las luces encendidas."), ("N-1/2000#art2", "El conductor respetará las señales de la vía.")]
GOOD = "CITAS\n[[REF:1]] «llevarán siempre las luces»\nRESPUESTA\nLas luces [[REF:1]]."
BAD = "CITAS\n[[REF:2]] «no está en la fuente»\nRESPUESTA\nNo."
OUT = "Dice [[REF:9]] y sigue y sigue"
CANNOT = "no puedo responder a eso"
#: Drafts by attempt, and the relevance.
COURSES = {"a": ([GOOD], 0.5), "b": ([OUT, GOOD], None), "c": ([CANNOT], 0.5), "d": ([BAD, OUT, BAD], 0.5), "e": ([GOOD], 0.05), "f": ([BAD, BAD, GOOD], 0.5), "g": ([GOOD, BAD], 0.9), "h": ([BAD, CANNOT, GOOD], 0.5)}


@pytest.fixture
def few_partitions(spark):
    """A stateful operator starts a worker for each partition in each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tokens_of(draft, r):
    at = sorted({0, len(draft), *(r.randrange(len(draft)) for _ in range(6))})
    return [draft[a:b] for a, b in zip(at, at[1:])]


def test_serve_stream_equals_batch(spark, tmp_path, few_partitions):
    r = random.Random(9)
    source = "array<struct<ref:string,texto:string>>"
    requests = spark.createDataFrame([(k, "q", SOURCES if k != "g" else [], rel) for k, (_, rel) in COURSES.items()], f"request_id string, pregunta string, sources {source}, relevance double")
    rows = [(k, a, i, t, 0 if k == "g" else 2, i == len(ts) - 1) for k, (drafts, _) in COURSES.items() for a, d in enumerate(drafts) for ts in [tokens_of(d, r)] for i, t in enumerate(ts)]
    schema = "request_id string, attempt int, seq bigint, token string, n_sources int, is_last boolean"
    all_tokens = spark.createDataFrame(rows, schema)
    emit = lambda df, attempt: all_tokens.where(F.col("attempt") == attempt).join(df.select("request_id"), "request_id", "left_semi").select("request_id", "seq", "token")
    shown, results = verification.serve_requests(requests, emit)
    want = {x.request_id: (x.salida, x.reintentos, x.refs, x.motivo, x.answer) for x in results.collect()}
    assert want["a"] == (C.ANSWER, 0, ["N-1/2000#art1"], None, "Las luces [[REF:1]].") and want["b"][:2] == (C.ANSWER, 1) and want["e"][3] == C.NOT_RELEVANT
    want_shown = {(x.request_id, x.attempt): x.emitted for x in shown.collect() if x.emitted}

    for turn in range(1):
        folder = tmp_path / str(turn)
        shuffled, asked = rows[:], list(COURSES)
        r.shuffle(shuffled)
        for i in range(3):
            spark.createDataFrame(shuffled[i::3], schema).coalesce(1).write.mode("append").json(f"{folder}/tokens")
            spark.createDataFrame([(k,) for k in asked[i::3]], "request_id string").coalesce(1).write.mode("append").json(f"{folder}/asked")
        read = lambda name, kind, folder=folder: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{folder}/{name}")
        served = serve.serve_requests_stream(read("asked", "request_id string"), read("tokens", schema), requests)
        q = served.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination(240)
        assert q.exception() is None
        got = spark.read.parquet(f"{folder}/out").collect()
        ends = [x for x in got if x.kind == serve.RESULT]
        assert {x.request_id: (x.salida, x.reintentos, x.refs, x.motivo, x.answer) for x in ends} == want and len(ends) == len(want)
        pieces = {}
        for x in sorted((x for x in got if x.kind == serve.PIECE), key=lambda x: x.seq):
            pieces[x.request_id, x.attempt] = pieces.get((x.request_id, x.attempt), "") + x.text
        assert pieces == want_shown
        assert {(x.request_id, x.attempt) for x in got if x.kind == serve.RETRACT} == {("b", 0), ("d", 1), ("g", 0)}  # without sources any hole is one too many


def test_a_request_that_waits_in_vain_ends(spark, tmp_path, few_partitions):
    import time

    requests = spark.createDataFrame([("a", SOURCES, 0.5)], "request_id string, sources array<struct<ref:string,texto:string>>, relevance double")
    schema = "request_id string, attempt int, seq bigint, token string, n_sources int, is_last boolean"
    spark.createDataFrame([("a", 0, 0, "Hola", 2, False)], schema).write.json(f"{tmp_path}/tokens")
    spark.createDataFrame([("a",)], "request_id string").write.json(f"{tmp_path}/asked")
    read = lambda name, kind: spark.readStream.schema(kind).json(f"{tmp_path}/{name}")
    served = serve.serve_requests_stream(read("asked", "request_id string"), read("tokens", schema), requests, wait_ms=1000)
    q = served.writeStream.format("memory").queryName("waited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(150):
            time.sleep(1)
            got = {x.kind: x for x in spark.table("waited").collect()}
            if serve.RESULT in got or q.exception():
                break
    finally:
        q.stop()
    assert q.exception() is None and got[serve.PIECE].text == "Hola" and (got[serve.RESULT].salida, got[serve.RESULT].motivo) == (C.ABSTAIN, C.NO_CITATIONS)


def test_read_sse(spark):
    lines = [
        'data: {"texto":"before any name"}', ": comment", "event: sources", 'data: {"fuentes":[{"legal_ref":"r","n":1,"titulo":"t"}]}', "", "event:token", 'data: {"texto":"a"}', 'data: {"texto":"b"}',
        "event: other", 'data: {"texto":"x"}', "event: token", 'data: {"texto":null}', 'data:{"texto":"c"}', "event: citations", 'data: {"citas":[{"legal_ref":"r","n":1,"quote":"q"}]}', "event: done", 'data: {"latencias_ms":{"total":3.5}}',
    ]
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", 1, 'data: {"motivo":"m"}'), ("b", 0, "event: abstain"), ("c", 0, "event: error"), ("c", 1, 'data: {"detalle":"no model"}'), ("d", 0, ""), ("e", 0, "event: abstain"), ("e", 1, "data: {}")]
    df = spark.createDataFrame(rows, "request_id string, line_no int, line string").repartition(3)
    got = {x.request_id: x for x in verification.read_sse(df).collect()}
    a = got["a"]
    assert a.texto == "abc" and [tuple(c) for c in a.citas] == [("r", "q")] and a.fuentes[0].titulo == "t" and a.latencias_ms == {"total": 3.5} and not a.abstenida and a.motivo == ""
    assert [(got[k].abstenida, got[k].motivo) for k in "bcde"] == [(True, "m"), (True, "error: no model"), (False, ""), (True, "")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        verification.read_sse(spark.createDataFrame([("a", 0, "event: token"), ("a", 1, "data: {not json")], "request_id string, line_no int, line string")).collect()


def test_no_line_is_read_after_a_retraction(spark, tmp_path, few_partitions):
    from lexweave.sources.models import http_token_events, http_token_stream
    from lexweave.streaming.guard import guard_stream

    log = tmp_path / "log"
    log.mkdir()
    answers = {"good": ["As ", "[[RE", "F:1]]", " says."], "bad": ["see ", "[[REF:", "7]]", " and", " more", " and more"], "none": []}

    def lines(url, body, timeout, log=str(log), answers=answers):
        import pathlib
        import uuid

        name = body["messages"][0]["content"]
        told = pathlib.Path(log, f"{name}-{uuid.uuid4().hex}")
        try:
            for t in answers[name]:
                with told.open("a") as f:
                    f.write(t + "|")
                yield "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
            yield "data: [DONE]"
        finally:
            with told.open("a") as f:
                f.write("closed")

    events = http_token_events("http://x", "m", lines=lines, at_once=2)
    rows = [(k, 0, k, 2) for k in answers]
    got = {}
    for x in events(spark.createDataFrame(rows, "request_id string, attempt int, prompt string, n_sources int")).collect():
        got.setdefault(x.request_id, []).append((x.seq, x.token, x.is_last))
    assert sorted(got["good"]) == [(0, "As ", False), (1, "[[RE", False), (2, "F:1]]", False), (3, " says.", True)]
    assert sorted(got["bad"]) == [(0, "see ", False), (1, "[[REF:", False), (2, "7]]", True)] and got["none"] == [(0, "", True)]
    read = lambda name: [p.read_text() for p in log.glob(f"{name}-*")]
    assert read("bad") == ["see |[[REF:|7]]|closed"] and read("good") == ["As |[[RE|F:1]]| says.|closed"]

    # The same from a stream of requests, through the guard; and for serving in batch.
    spark.createDataFrame(rows, "request_id string, attempt int, prompt string, n_sources int").coalesce(1).write.json(f"{tmp_path}/in")
    asked = spark.readStream.schema("request_id string, attempt int, prompt string, n_sources int").json(f"{tmp_path}/in")
    q = guard_stream(events(asked)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    ends = {x.request_id: x.state for x in spark.read.parquet(f"{tmp_path}/out").where("done").collect()}
    assert ends == {"good": "abierto", "bad": "retractado", "none": "abierto"} and all(t == "see |[[REF:|7]]|closed" for t in read("bad")) and len(read("bad")) == 2
    served = http_token_stream("http://x", "m", lines=lines)(spark.createDataFrame([("bad", "bad", SOURCES)], "request_id string, prompt string, sources array<struct<ref:string,texto:string>>"), 0)
    assert [x.token for x in served.orderBy("seq").collect()] == answers["bad"][:3]
