"""Verification of drafts against their sources, and the course of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import citations as C
from ..functions.text import fold_each_for_compare, fold_for_compare, segments


def verify(drafts: DataFrame, keys: tuple[str, ...] = ("request_id", "attempt")) -> DataFrame:
    """``keys``, ok, refs, motivo for each row of (keys, sources, citations).

    All or nothing: the first citation that fails gives the reason; without
    citations there is one too. References come in the order of the citations.
    """
    none = F.lit(None).cast("string")
    one = drafts.select(*keys, "sources", F.posexplode_outer("citations").alias("pos", "c"))
    source = F.get("sources", F.col("c.n") - 1)
    one = one.select(*keys, "pos", "c", F.size("sources").alias("n_sources"), source["ref"].alias("ref"), fold_for_compare(source["texto"]).alias("text"), fold_for_compare(F.col("c.quote")).alias("quote"), F.when(F.col("c.segmento").isNotNull(), F.size(segments(source["texto"]))).alias("n_segments"))
    reason = F.when(F.col("pos").isNull(), F.lit(C.NO_CITATIONS)).otherwise(C.citation_reason(F.col("c.n"), F.col("c.segmento"), F.col("n_sources"), F.col("n_segments"), F.col("quote"), F.col("text")))
    judged = one.select(*keys, F.coalesce("pos", F.lit(0)).alias("pos"), reason.alias("reason"), "ref")
    seen = judged.groupBy(*keys).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "reason"))).alias("bad"), F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("refs"))
    ok = F.col("bad").isNull()
    return seen.select(*keys, ok.alias("ok"), F.when(ok, F.transform("refs", lambda r: r["ref"])).otherwise(F.expr("cast(array() as array<string>)")).alias("refs"), F.when(ok, none).otherwise(F.col("bad.reason")).alias("motivo"))


def verify_rows(drafts: DataFrame) -> DataFrame:
    """``verify`` row by row, without a shuffle, for streams: adds ok, refs, motivo to rows with sources and citations."""
    quotes = fold_each_for_compare(F.transform("citations", lambda c: c["quote"]))
    texts = fold_each_for_compare(F.transform("sources", lambda s: s["texto"]))
    df = drafts.withColumns({"_q": quotes, "_t": texts})

    def reason(c: Column, i: Column) -> Column:
        pieces = F.when(c["segmento"].isNotNull(), F.size(segments(F.get("sources", c["n"] - 1)["texto"])))
        return C.citation_reason(c["n"], c["segmento"], F.size("sources"), pieces, F.get("_q", i), F.get("_t", c["n"] - 1))

    df = df.withColumn("_r", F.transform("citations", reason))
    bad = F.when(F.size("citations") == 0, F.lit(C.NO_CITATIONS)).otherwise(F.get(F.filter("_r", lambda r: r.isNotNull()), F.lit(0)))
    refs = F.transform("citations", lambda c: F.get("sources", c["n"] - 1)["ref"])
    return df.withColumns({"motivo": bad, "ok": bad.isNull(), "refs": F.when(bad.isNull(), refs).otherwise(F.expr("cast(array() as array<string>)"))}).drop("_q", "_t", "_r")


def courses(verdicts: DataFrame) -> DataFrame:
    """request_id, salida, reintentos, refs, motivo from (request_id, attempt, ok, refs, motivo, has_sources, relevance).

    Attempts count from 0. The first attempt that is not to be retried decides; if
    none is, the request is abstained with the last reason.
    """
    low = F.coalesce((F.col("relevance") < C.LEAST_RELEVANCE) & F.col("has_sources"), F.lit(False))
    each = verdicts.withColumns({"low": low, "out": C.decide(F.col("ok"), F.col("attempt"), F.col("has_sources"), F.col("relevance"))})
    row = F.struct("attempt", "out", "refs", "motivo")
    by = each.groupBy("request_id").agg(F.max("low").alias("low"), F.min(F.when(F.col("out") != C.RETRY, row)).alias("first"), F.max(F.struct("attempt", "motivo")).alias("last"))
    answered = F.coalesce(F.col("first.out") == C.ANSWER, F.lit(False)) & ~F.col("low")
    return by.select(
        "request_id",
        F.when(answered, C.ANSWER).otherwise(C.ABSTAIN).alias("salida"),
        F.when(F.col("low"), 0).otherwise(F.coalesce("first.attempt", "last.attempt")).cast("int").alias("reintentos"),
        F.when(answered, F.col("first.refs")).otherwise(F.expr("cast(array() as array<string>)")).alias("refs"),
        F.when(F.col("low"), C.NOT_RELEVANT).when(answered, F.lit(None)).otherwise(F.when(F.col("first").isNotNull(), F.col("first.motivo")).otherwise(F.col("last.motivo"))).alias("motivo"),
    )


def drafts_to_verdicts(drafts: DataFrame) -> DataFrame:
    """Parses, verifies and decides: (request_id, attempt, draft, sources, relevance) to request_id, attempt, answer, ok, refs, motivo.

    Drafts with a column retracted that is true point outside their sources.
    """
    parsed = drafts.withColumn("parts", C.split_draft(F.col("draft"))).withColumn("citations", C.parse_citations(F.col("parts.lines"), F.col("sources")))
    told = verify(parsed)
    if "retracted" in drafts.columns:
        cut = F.col("retracted")
        told = told.join(parsed.select("request_id", "attempt", "retracted"), ["request_id", "attempt"])
        told = told.select("request_id", "attempt", (F.col("ok") & ~cut).alias("ok"), F.when(cut, F.expr("cast(array() as array<string>)")).otherwise(F.col("refs")).alias("refs"), F.when(cut, C.OUT_OF_RANGE).otherwise(F.col("motivo")).alias("motivo"))
    return parsed.select("request_id", "attempt", F.col("parts.prose").alias("answer"), "citations", C.says_cannot(F.col("draft")).alias("cannot"), (F.size("sources") > 0).alias("has_sources"), "relevance").join(told, ["request_id", "attempt"])


def answer_requests(requests: DataFrame, generate, most_retries: int = C.MOST_RETRIES) -> DataFrame:
    """Drafts, verifies and retries in at most ``most_retries + 1`` passes over the requests still undecided.

    ``requests`` has request_id, pregunta, sources, relevance; ``generate(df, attempt)``
    adds draft. Gives request_id, salida, reintentos, refs, motivo, answer. Nothing is
    generated for a request whose sources are not relevant. Each attempt's drafts are
    written, so each is asked for once and told as it was judged.
    """
    far = F.coalesce((F.col("relevance") < C.LEAST_RELEVANCE) & (F.size("sources") > 0), F.lit(False))
    open_requests, told = requests.where(~far), None
    for attempt in range(most_retries + 1):
        drafts = written(generate(open_requests, attempt).withColumn("attempt", F.lit(attempt)))
        now = drafts_to_verdicts(drafts)
        told = now if told is None else told.unionByName(now)
        again = now.where((C.decide(F.col("ok"), F.col("attempt"), F.col("has_sources"), F.col("relevance")) == C.RETRY) & ~F.col("cannot"))
        if again.isEmpty():
            break
        open_requests = open_requests.join(again.select("request_id"), "request_id", "left_semi")
    course = courses(told)
    # A draft that says it can't answer ends its request.
    last = told.groupBy("request_id").agg(F.max("cannot").alias("cannot"), F.max("attempt").alias("attempt"))
    final = course.join(last, "request_id").withColumns({"salida": F.when(F.col("cannot"), C.ABSTAIN).otherwise(F.col("salida")), "motivo": F.when(F.col("cannot"), F.lit(None)).otherwise(F.col("motivo")), "reintentos": F.when(F.col("cannot"), F.col("attempt")).otherwise(F.col("reintentos")), "refs": F.when(F.col("cannot"), F.expr("cast(array() as array<string>)")).otherwise(F.col("refs"))})
    prose = told.select("request_id", F.col("attempt").alias("reintentos"), "answer")
    out = final.drop("cannot", "attempt").join(prose, ["request_id", "reintentos"], "left")
    out = out.withColumn("answer", F.when(F.col("salida") == C.ANSWER, F.col("answer")))
    none = requests.where(far).select("request_id", F.lit(0).alias("reintentos"), F.lit(C.ABSTAIN).alias("salida"), F.expr("cast(array() as array<string>)").alias("refs"), F.lit(C.NOT_RELEVANT).alias("motivo"), F.lit(None).cast("string").alias("answer"))
    return out.unionByName(none)


def serve_requests(requests: DataFrame, emit, most_retries: int = C.MOST_RETRIES) -> tuple[DataFrame, DataFrame]:
    """What is shown while answers are written, and the results of ``answer_requests``.

    ``emit(df, attempt)`` gives (request_id, seq, token). Each attempt goes through
    the guard: only what it lets out is shown and verified, and an attempt that it
    retracts is judged as one that cites outside its sources. The pieces are
    request_id, attempt, emitted, holes, state.
    """
    from ..streaming.guard import RETRACTED, guard

    none = "request_id {}, attempt int, emitted string, holes array<int>, state string".format(requests.schema["request_id"].dataType.simpleString())
    shown = [requests.sparkSession.createDataFrame([], none)]

    def generate(rows: DataFrame, attempt: int) -> DataFrame:
        tokens = emit(rows, attempt).join(rows.select("request_id", F.size("sources").alias("n_sources")), "request_id")
        pieces = written(guard(tokens.withColumn("attempt", F.lit(attempt))))
        shown[0] = shown[0].unionByName(pieces)
        told = pieces.select("request_id", F.col("emitted").alias("draft"), (F.col("state") == RETRACTED).alias("retracted"))
        return rows.join(told, "request_id", "left").withColumns({"draft": F.coalesce("draft", F.lit("")), "retracted": F.coalesce("retracted", F.lit(False))})

    results = written(answer_requests(requests, generate, most_retries))  # every attempt has been made now
    return shown[0], results


def sse_events(results: DataFrame) -> DataFrame:
    """request_id, seq, event, data (JSON with sorted keys) for each result.

    ``results``: request_id, salida, reintentos, motivo, answer, refs, citations, sources.
    The order is sources, a retract for each retry, token and citations or abstain, done.
    """
    sources = F.to_json(F.struct(F.transform("sources", lambda s, i: F.struct(s["ref"].alias("legal_ref"), (i + 1).alias("n"), F.substring_index(s["texto"], "\n", 1).alias("titulo"))).alias("fuentes")))
    retries = F.when(F.col("reintentos") > 0, F.transform(F.sequence(F.lit(1), F.col("reintentos")), lambda i: F.struct(F.lit("retract").alias("event"), F.to_json(F.struct(i.alias("intento"), F.when((i == F.col("reintentos")) & F.col("motivo").isNotNull(), F.col("motivo")).otherwise("no_verificado").alias("motivo"))).alias("data")))).otherwise(F.expr("cast(array() as array<struct<event:string,data:string>>)"))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    cited = F.to_json(F.struct(F.zip_with(F.slice("citations", F.lit(1), F.size("refs")), "refs", lambda c, r: F.struct(r.alias("legal_ref"), c["n"].alias("n"), c["quote"].alias("quote"))).alias("citas")))
    answered = F.array(event("token", F.to_json(F.struct(F.col("answer").alias("texto")))), event("citations", cited))
    abstained = F.array(event("abstain", F.to_json(F.struct(F.coalesce("motivo", F.lit("sin_fuentes")).alias("motivo"), F.col("reintentos").alias("reintentos")))))
    done = F.array(event("done", F.to_json(F.struct(F.col("reintentos").alias("reintentos"), F.col("salida").alias("salida")))))
    every = F.concat(F.array(event("sources", sources)), retries, F.when(F.col("salida") == C.ANSWER, answered).otherwise(abstained), done)
    return results.select("request_id", F.posexplode(every).alias("seq", "e")).select("request_id", "seq", "e.event", "e.data")


def sse_lines(events: DataFrame) -> DataFrame:
    """request_id, line_no, line: events as the lines that a client reads: name, data, and an empty one."""
    lines = F.array(F.concat(F.lit("event: "), F.col("event")), F.concat(F.lit("data: "), F.col("data")), F.lit(""))
    each = events.select("request_id", "seq", F.posexplode(lines).alias("k", "line"))
    return each.select("request_id", (F.col("seq") * 3 + F.col("k")).alias("line_no"), "line")


def read_sse(lines: DataFrame) -> DataFrame:
    """request_id, texto, citas, fuentes, abstenida, motivo, latencias_ms: what a client shows of each answer, from its lines.

    ``lines``: request_id, line_no, line. Data belong to the last event named before
    them, wherever its line stands; what comes before any name, lines of another kind, and events that are not known, change nothing. Texts of
    token events are joined in order; of sources, citations and the reason the last
    counts. An error is an abstention whose reason begins with "error: ". Data that are not JSON fail the query.
    """
    named = F.when(F.col("line").startswith("event:"), F.trim(F.substring("line", 7, 1 << 30)))
    order = Window.partitionBy("request_id").orderBy("line_no")
    told = lines.withColumn("event", F.last(named, ignorenulls=True).over(order)).where(F.col("line").startswith("data:"))
    data = F.trim(F.regexp_replace(F.substring("line", 6, 1 << 30), r"\n+\z", ""))
    kinds = "struct<fuentes:array<struct<legal_ref:string,n:int,titulo:string>>,texto:string,citas:array<struct<legal_ref:string,quote:string>>,motivo:string,detalle:string,latencias_ms:map<string,double>>"
    told = told.select("request_id", "line_no", "event", F.from_json(data, kinds, {"mode": "FAILFAST"}).alias("d"))
    last = lambda value, *events: F.max_by(value, F.when(F.col("event").isin(*events), F.col("line_no")))
    reason = F.when(F.col("event") == "abstain", F.coalesce("d.motivo", F.lit(""))).otherwise(F.concat(F.lit("error: "), F.coalesce("d.detalle", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("line_no", F.coalesce("d.texto", F.lit("")).alias("t")))))
    ended = F.max(F.col("event").isin("abstain", "error"))
    of = told.groupBy("request_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("texto"),
        F.coalesce(last(F.col("d.citas"), "citations"), F.expr("cast(array() as array<struct<legal_ref:string,quote:string>>)")).alias("citas"),
        F.coalesce(last(F.col("d.fuentes"), "sources"), F.expr("cast(array() as array<struct<legal_ref:string,n:int,titulo:string>>)")).alias("fuentes"),
        F.coalesce(ended, F.lit(False)).alias("abstenida"),
        F.coalesce(last(reason, "abstain", "error"), F.lit("")).alias("motivo"),
        F.coalesce(last(F.col("d.latencias_ms"), "done"), F.expr("cast(map() as map<string,double>)")).alias("latencias_ms"),
    )
    empty = lines.select("request_id").distinct().join(of, "request_id", "left")  # an answer may have no data
    none = {"texto": F.lit(""), "citas": F.expr("cast(array() as array<struct<legal_ref:string,quote:string>>)"), "fuentes": F.expr("cast(array() as array<struct<legal_ref:string,n:int,titulo:string>>)"), "abstenida": F.lit(False), "motivo": F.lit(""), "latencias_ms": F.expr("cast(map() as map<string,double>)")}
    return empty.withColumns({c: F.coalesce(F.col(c), d) for c, d in none.items()})
