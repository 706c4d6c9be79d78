"""Search, structure, chunking, citations, metrics, statistics and sampling."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import citations as C
from lexweave.operators import chunking, golden, metrics, sampling, search, stats, structure, verification
from lexweave.plans import evaluate
from lexweave.sources.lawxml import LawXmlSource, blocks_of, read_law_xml

LAW = """<?xml version="1.0"?><response><data><documento><texto>
<bloque id="pr" tipo="preambulo" titulo="[preambulo]"><version id_norma="N" fecha_vigencia="20000101"><p class="x">Preamble.</p></version></bloque>
<bloque id="u" tipo="precepto" titulo="Artículo 1"><version id_norma="N0"><p class="articulo">Artículo 1. Aprobación.</p><p class="parrafo">Se aprueba.</p></version></bloque>
<bloque id="rg" tipo="encabezado" titulo="REGLAMENTO"><version id_norma="N"><p class="x">R</p></version></bloque>
<bloque id="t1" tipo="encabezado" titulo="TÍTULO I"><version id_norma="N"><p class="titulo_num">TÍTULO I</p></version></bloque>
<bloque id="c1" tipo="encabezado" titulo="CAPÍTULO I"><version id_norma="N"><p class="capitulo_num">C</p></version></bloque>
<bloque id="a1" tipo="precepto" titulo="Artículo 1"><version id_norma="OLD"><p class="articulo">Artículo 1. Viejo.</p><p class="parrafo">Viejo.</p></version><version id_norma="N1" fecha_vigencia="20200101"><p class="articulo">Artículo 1. Objeto.</p><p class="parrafo">1. Primero.</p><p class="parrafo">a) Sigue.</p><p class="parrafo">2. Segundo <strong>fuerte</strong> fin.</p><blockquote><p class="parrafo">No.</p></blockquote></version></bloque>
<bloque id="a2" tipo="precepto" titulo="Artículo 14 bis"><version id_norma="N1"><p class="articulo">Artículo 14 bis. Único.</p><p class="parrafo">Texto sin número.</p></version></bloque>
<bloque id="a3" tipo="precepto" titulo="Artículo 15"><version id_norma="N1"><p class="articulo">Artículo 15.</p><p class="parrafo"><strong>(Derogado).</strong></p></version></bloque>
<bloque id="t2" tipo="encabezado" titulo="TÍTULO II"><version id_norma="N"><p class="titulo_num">II</p></version></bloque>
<bloque id="b1" tipo="precepto" titulo="Artículo 1"><version id_norma="N1"><p class="articulo">Artículo 1. Otro.</p><p class="parrafo">Cuerpo.</p></version></bloque>
<bloque id="d1" tipo="precepto" titulo="Disposición adicional primera"><version id_norma="N1"><p class="articulo">Disposición adicional primera. D.</p><p class="parrafo">Cuerpo.</p></version></bloque>
<bloque id="an" tipo="encabezado" titulo="ANEXO I"><version id_norma="N1"><p class="anexo">ANEXO I</p><p class="parrafo">Tabla.</p></version></bloque>
<bloque id="an1" tipo="precepto" titulo="Artículo 1"><version id_norma="N1"><p class="articulo">Artículo 1. Anexado.</p><p class="parrafo">Dentro.</p></version></bloque>
</texto></documento></data></response>"""


@pytest.fixture(scope="module")
def units(spark):
    docs = spark.createDataFrame([("law", LAW)], "doc_id string, xml string")
    return structure.units(blocks_of(docs), F.lit("RD-1/2003")).orderBy("pos")


def test_units(units):
    units = units.collect()
    assert [(u.articulo, u.titulo, u.capitulo, u.tipo, u.vigente) for u in units] == [
        ("rd-1", None, None, "articulo", True),
        ("ti-1", "TÍTULO I", "CAPÍTULO I", "articulo", True),
        ("14bis", "TÍTULO I", "CAPÍTULO I", "articulo", True),
        ("15", "TÍTULO I", "CAPÍTULO I", "articulo", False),
        ("tii-1", "TÍTULO II", None, "articulo", True),
        ("daprimera", "TÍTULO II", None, "disposicion", True),
        ("anexoi", "TÍTULO II", None, "anexo", True),
        ("anexoi-1", None, None, "articulo", True),
    ]
    first = units[1]
    assert first.rubrica == "Objeto." and first.id_norma_version == "N1" and first.fecha_vigencia == "20200101"
    assert [tuple(a) for a in first.apartados] == [("1", "Primero.\na) Sigue."), ("2", "Segundo fuerte fin.")]


def test_xml_problems(spark):
    bad = [("a", ""), ("b", "<!DOCTYPE x><response/>"), ("c", "<response><texto>"), ("d", "<response/>"), ("e", LAW)]
    docs = spark.createDataFrame(bad, "doc_id string, xml string")
    errors = {r.doc_id: r.error for r in blocks_of(docs).where("error is not null").collect()}
    assert set(errors) == {"a", "b", "c", "d"} and errors["b"] == "DTD or entities"
    assert blocks_of(docs, mode="DROPMALFORMED").select("doc_id").distinct().count() == 1
    with pytest.raises(Exception, match="empty document|DTD or entities|malformed|no text"):
        blocks_of(docs, mode="FAILFAST").collect()


def test_xml_files(spark, tmp_path):
    (tmp_path / "law.xml").write_text(LAW, encoding="utf-8")
    spark.dataSource.register(LawXmlSource)
    by_source = spark.read.format("law_xml").load(f"{tmp_path}/*.xml")
    assert by_source.count() == read_law_xml(spark, str(tmp_path)).count() == 13


def test_chunkers(spark, units):
    df = units
    article = chunking.chunk_article(df, F.lit("uri")).orderBy("ordinal").collect()
    assert [c.ordinal for c in article] == list(range(7)) and article[1].content == "Artículo 1. Objeto.\n1. Primero.\na) Sigue.\n2. Segundo fuerte fin."
    items = chunking.chunk_paragraph(df, F.lit("uri")).orderBy("ordinal").collect()
    assert [c.ref for c in items][1:3] == ["RD-1/2003#artti-1.1", "RD-1/2003#artti-1.2"] and len(items) == 8
    both = chunking.chunk_multilevel(df, F.lit("uri")).orderBy("ordinal").collect()
    assert len(both) == 9 and both[0].ref == "RD-1/2003#artti-1" and len({c.chunk_id for c in both}) == 9
    with pytest.raises(Exception, match="empty source_uri"):
        chunking.chunk_article(df, F.lit(" ")).collect()
    with pytest.raises(ValueError):
        chunking.chunker("other")


def test_rrf(spark):
    def ranking(names):
        return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], "query_id int, legal_ref string, rank int")

    def fused(*lists):
        return [r.legal_ref for r in search.rrf([ranking(x) for x in lists]).orderBy("rank").collect()]

    assert fused("abc", "cba") == ["a", "c", "b"]
    assert fused("aab", "a") == ["a", "b"]
    assert fused("", "") == []
    score = {r.legal_ref: r.score for r in search.rrf([ranking("aab"), ranking("a")]).collect()}
    assert score["b"] == pytest.approx(1 / 63) and score["a"] == pytest.approx(2 / 61)
    with pytest.raises(ValueError):
        search.rrf([ranking("a")], k=0)


def test_vector_index(spark, monkeypatch, tmp_path):
    from lexweave.operators import vector_index

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(90, 6)).round(3), np.repeat(r.normal(size=(5, 6)), 30, axis=0) + 0.05 * r.normal(size=(150, 6)), np.ones((40, 6))])
    n = len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [0.0] * 6), (1003, [2.0]), (1004, [])], "vec_id bigint, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 7 = 0 or vec_id > 999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUESTIONS", 5)
    u = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((1, 6))])
    ids = [*range(n), 1002]
    want = {}
    for q in [*range(0, n, 7), 1002]:
        d = np.round(1 - u @ u[ids.index(q)], 12)
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:4]
        want |= {(q, k + 1): (ids[i], d[i]) for k, i in enumerate(order)}
    want |= {(1001, 1): (1003, 0.0), (1003, 1): (1001, 0.0)}
    for lists in (None, 1, 12, 60):
        got = {(g.query_id, g.rank): (g.vec_id, g.distance) for g in search.vector_topk(asked, df, 4, id_col="vec_id", skip_self=True, lists=lists).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}, lists
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    # Stored by version, approximate, and what it visits.
    index = vector_index.build(df, "vec_id", lists=12)
    index.write(str(tmp_path), "v1")
    again = vector_index.VectorIndex.read(spark, str(tmp_path), "v1")
    exact = again.search(asked, 4, id_col="vec_id", probes=2)
    near = again.search(asked, 4, id_col="vec_id", probes=2, exact=False)
    rows = vector_index.recall(near, exact, id_col="vec_id").collect()
    assert sum(r.found for r in rows) >= 0.6 * sum(r.n for r in rows) and all(r.n == 4 or r.n <= 2 for r in rows)
    assert again.search(asked.limit(0), 3, id_col="vec_id").count() == 0 == vector_index.build(df.limit(0), "vec_id").search(asked, 3, id_col="vec_id").count()
    # Shells that can't hold anything nearer are not visited.
    one = spark.createDataFrame([(0, [1.0] * 6, 0.0)], "q bigint, v array<double>, kth double")
    reached, every = again._targets(one, 2, False).count(), again.shells.where("list >= 0").count()
    assert reached < every / 2


def test_rerank(spark):
    df = spark.createDataFrame([(1, f"r{i}", i, p) for i, p in enumerate([0.1, 0.9, 0.9, None], 1)], "query_id int, legal_ref string, rank int, points double")
    assert [r.legal_ref for r in search.rerank_scores(df, head=3).orderBy("rank").collect()] == ["r2", "r3", "r1", "r4"]
    with pytest.raises(Exception, match="no points"):
        search.rerank_scores(df).collect()
    answers = spark.createDataFrame([(1, "AC AA ZZ AC xAB")], "query_id int, answer string")
    assert [r.legal_ref for r in search.rerank_labels(df.drop("points"), answers).orderBy("rank").collect()] == ["r3", "r1", "r2", "r4"]
    assert search.labels(3) == ["AA", "AB", "AC"] and len(search.labels(1000)) == 676


def test_a_short_ranking_meets_documents_where_they_are_read(spark, monkeypatch):
    from lexweave.plans import ask, registry

    docs = spark.createDataFrame([(f"r{i % 50}", i) for i in range(60)] + [(None, 99)], "legal_ref string, points int")
    ranked = spark.createDataFrame([(q, f"r{q * 7 % 60}", q % 3) for q in range(40)] + [(41, None, 0)], "query_id int, legal_ref string, rank int")
    want = sorted((q, ref, rank, p) for q, ref, rank in map(tuple, ranked.collect()) for r, p in map(tuple, docs.collect()) if ref is not None and r == ref)
    found = lambda: search.with_payload(ranked, docs).select("query_id", "legal_ref", "rank", "points")
    assert sorted(map(tuple, found().collect())) == want
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", 40)  # too many rows: by shuffle
    assert sorted(map(tuple, found().collect())) == want
    monkeypatch.undo()
    # The query, and an answer from chunks, whose texts are long: neither joins by shuffle, however large the documents are thought to be.
    rows = [(i, f"la ley w{i}", i) for i in range(30)]
    monkeypatch.setattr(registry, "table", lambda s, _, name: s.createDataFrame(rows, "doc_id bigint, text string, n_chars int") if name == "documents" else s.createDataFrame([(1, "ley w3")], "item_id int, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([(f"N-1/2000#art{i}", f"la ley w{i}", "t", "m", [1.0, float(i)]) for i in range(9)], "ref string, content string, titulo string, materia string, embedding array<double>")
        asked = spark.createDataFrame([("q", "ley w3", [1.0, 3.0])], "query_id string, pregunta string, vector array<double>")
        for df in (registry.queries()["rerank_head_tail"](spark, ""), ask.retrieve(asked, chunks, 2), ask.ask(asked, chunks, 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
            assert df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SOURCES = [("N-1/2000#art1", "El titular del permiso. Deberá llevarlo siempre consigo."), ("N-1/2000#art2", "La velocidad máxima será de 120 km/h.")]
DRAFTS = {
    "ok": ("RESP\nCITAS\n[[REF:2]] «La velocidad máxima»", True, None, ["N-1/2000#art2"]),
    "first": ("CITAS\n[[REF:1]] §2\nRESPUESTA\nSiempre.", True, None, ["N-1/2000#art1"]),
    "none": ("Sin bloque", False, C.NO_CITATIONS, []),
    "range": ("CITAS\n[[REF:3]] «La velocidad»", False, C.OUT_OF_RANGE, []),
    "zero": ("CITAS\n[[REF:0]] «La velocidad»", False, C.OUT_OF_RANGE, []),
    "segment": ("CITAS\n[[REF:1]] S9", False, C.SEGMENT_OUT_OF_RANGE, []),
    "empty": ("CITAS\n[[REF:1]] «»", False, C.EMPTY_QUOTE, []),
    "short": ("CITAS\n[[REF:1]] «titular»", False, C.SHORT_QUOTE, []),
    "wrong": ("CITAS\n[[REF:1]] «La velocidad máxima»", False, C.NOT_LITERAL, []),
    "one bad": ("CITAS\n[[REF:2]] «La velocidad máxima»\n[[REF:1]] «no lo dice nadie»", False, C.NOT_LITERAL, []),
}


def test_drafts(spark):
    source = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(t).alias("texto")) for r, t in SOURCES])
    df = spark.createDataFrame([(k, 0, v[0], 0.5) for k, v in DRAFTS.items()], "request_id string, attempt int, draft string, relevance double").withColumn("sources", source)
    got = {r.request_id: r for r in verification.drafts_to_verdicts(df).collect()}
    for k, (_, ok, why, refs) in DRAFTS.items():
        assert (got[k].ok, got[k].motivo, got[k].refs) == (ok, why, refs), k
    assert got["first"].answer == "Siempre." and got["first"].citations[0].quote == "Deberá llevarlo siempre consigo."
    assert got["ok"].answer == "RESP" and got["none"].answer == "Sin bloque"


def test_retry_loop(spark):
    source = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(t).alias("texto")) for r, t in SOURCES])
    good, bad, cannot = DRAFTS["ok"][0], DRAFTS["wrong"][0], "no puedo responder"
    plan = {"a": [good], "b": [bad, good], "c": [bad, bad, bad], "d": [cannot], "e": [bad, cannot], "f": [good]}
    recorded = spark.createDataFrame([(k, i, d) for k, v in plan.items() for i, d in enumerate(v)], "request_id string, attempt int, draft string")
    from lexweave.sources.models import recorded_generator

    requests = spark.createDataFrame([(k, "q", 0.05 if k == "f" else None) for k in plan], "request_id string, pregunta string, relevance double").withColumn("sources", source)
    got = {r.request_id: (r.salida, r.reintentos, r.motivo) for r in verification.answer_requests(requests, recorded_generator(recorded)).collect()}
    assert got == {"a": (C.ANSWER, 0, None), "b": (C.ANSWER, 1, None), "c": (C.ABSTAIN, 2, C.NOT_LITERAL), "d": (C.ABSTAIN, 0, None), "e": (C.ABSTAIN, 1, None), "f": (C.ABSTAIN, 0, C.NOT_RELEVANT)}
    with pytest.raises(Exception, match="no recorded draft"):
        recorded_generator(recorded)(requests, 5).collect()


def test_each_draft_is_asked_for_once(spark, tmp_path):
    """A generator with a memory of its calls: one for each request and attempt, none for sources that don't matter."""
    source = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(t).alias("texto")) for r, t in SOURCES])
    requests = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", None), ("far", 0.01)], "request_id string, relevance double").withColumn("pregunta", F.lit("q")).withColumn("sources", source)
    bad, folder = DRAFTS["wrong"][0], str(tmp_path)

    def generate(rows, attempt):
        @F.udf("string")
        def draft(request):
            import uuid

            with open(f"{folder}/{request}-{attempt}-{uuid.uuid4().hex}", "w"):
                return bad

        return rows.withColumn("draft", draft.asNondeterministic()("request_id"))

    got = {r.request_id: (r.salida, r.reintentos, r.motivo) for r in verification.answer_requests(requests, generate).collect()}
    assert got == {**{k: (C.ABSTAIN, 2, C.NOT_LITERAL) for k in "abc"}, "far": (C.ABSTAIN, 0, C.NOT_RELEVANT)}
    calls = sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir())
    assert calls == sorted(f"{k}-{i}" for k in "abc" for i in range(3))


def test_serving_retracts_and_retries(spark):
    from lexweave.sources.models import http_token_stream

    source = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(t).alias("texto")) for r, t in SOURCES])
    good = DRAFTS["ok"][0]
    told = {("a", 0): good, ("b", 0): "see [[REF:99]] and more", ("b", 1): good, ("c", 0): "no puedo responder", ("d", 0): ""}

    def lines(url, body, timeout):
        request, attempt = body["messages"][0]["content"].split(":")
        text = told.get((request, int(attempt)), "nothing")
        assert body["stream"] and url.endswith("/v1/chat/completions")
        yield ": a comment"
        for k in range(0, len(text), 3):
            yield "data: " + json.dumps({"choices": [{"delta": {"content": text[k : k + 3]}}]}) + "\n"
        yield 'data: {"choices": [{"delta": {}}]}'
        yield "data: [DONE]"

    emit = http_token_stream("http://x", "m", lines=lines)
    requests = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.5), ("d", 0.5), ("e", 0.05)], "request_id string, relevance double").withColumn("pregunta", F.lit("q")).withColumn("sources", source)
    pieces, results = verification.serve_requests(requests, lambda rows, attempt: emit(rows.withColumn("prompt", F.concat("request_id", F.lit(f":{attempt}"))), attempt))
    got = {r.request_id: (r.salida, r.reintentos, r.motivo) for r in results.collect()}
    assert got == {"a": (C.ANSWER, 0, None), "b": (C.ANSWER, 1, None), "c": (C.ABSTAIN, 0, None), "d": (C.ABSTAIN, 2, C.NO_CITATIONS), "e": (C.ABSTAIN, 0, C.NOT_RELEVANT)}
    shown = {(r.request_id, r.attempt): (r.emitted, r.state) for r in pieces.collect()}
    assert shown["b", 0] == ("see ", "retractado") and shown["a", 0] == (good, "abierto") and not [k for k in shown if k[0] == "e"]


def plain_covers(units):
    """By the definition: windows that hold every unit and no shorter one."""
    at = [[p for p in unit[0] if all(p + k in word for k, word in enumerate(unit))] for unit in units]
    places = {p for unit in units for word in unit for p in word}
    whole = lambda b, e: all(any(b <= p and p + len(unit) - 1 <= e for p in starts) for unit, starts in zip(units, at))
    windows = [(b, e) for b in places for e in places if b <= e and whole(b, e) and not whole(b + 1, e) and not whole(b, e - 1)]
    return sum(0.1 / (1 + (e - b + 1) - sum(b <= p <= e for p in places)) for b, e in windows)


def test_text_index(spark, monkeypatch, tmp_path):
    from lexweave.operators import text_index
    from lexweave.plans import ask

    r = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"d{i:03d}", " ".join(r.choices(words, [1 / (k + 1) for k in range(25)], k=r.randint(0, 40)))) for i in range(300)] + [("d000", "w3 w3"), ("n", None)]
    docs = spark.createDataFrame([(*x, "own") for x in rows], "legal_ref string, content string, term string").repartition(4)
    asked = spark.createDataFrame([(i, " ".join(r.sample(words, r.randint(1, 4)))) for i in range(25)] + [(100, ""), (101, None), (102, "nothing w0 w0")], "query_id int, pregunta string")
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 8)
    text_index.build(docs).write(str(tmp_path), "a")
    index = text_index.stored(spark, str(tmp_path), "a", lambda: pytest.fail("it is there"))
    assert index.blocks == 38
    as_set = lambda df: {(x.query_id, x.legal_ref, x.score, x["rank"]) for x in df.collect()}
    for distinct in (False, True):
        for first in (2, 100):
            assert as_set(index.search(asked, 5, distinct=distinct, first_blocks=first)) == as_set(search.lexical_topk(asked, docs, 5, distinct=distinct))
    assert as_set(text_index.stored(spark, str(tmp_path), "b", lambda: docs).search(asked, 5)) == as_set(index.search(asked, 5))
    assert text_index.build(docs.limit(0)).search(asked, 5).count() == 0
    # One term: its folder alone is read.
    plan = index._of(index.postings, spark.createDataFrame([("w1",)], "term string").withColumn("bucket", text_index._bucket("term")))
    said = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.select("bucket").distinct().count() == 1 and "PartitionFilters: [isnotnull(bucket" in said

    said = ["w0 w1", '"w0 w1"', "w0 w2 -w1", 'w3 "w0 w1" w0', '"w0 w0"', '"w1 w0 w2" -w5', '-"w0 w7" w1', "-w1", "w0 nothing", '"w4"', "w1 w1"]
    q = spark.createDataFrame(list(enumerate(said)), "query_id int, said string").withColumn("asked", text_index.web_query(F.col("said")))
    parsed = {x.said: (x.asked.terms, x.asked.phrases, x.asked.excluded) for x in q.collect()}
    assert parsed['w3 "w0 w1" w0'] == (["w3", "w0"], [["w0", "w1"]], []) and parsed['-"w0 w7" w1'] == (["w1"], [], ["w0", "w7"]) and parsed['"w4"'] == (["w4"], [], [])
    unique = docs.where("content <> 'w3 w3'")
    want = {}
    for i, s in enumerate(said):
        terms, phrases, out = parsed[s]
        units = [[t] for t in dict.fromkeys(terms)] + phrases
        for ref, t in rows[:300]:
            there = t.split()
            if units and not set(out) & set(there) and set(sum(units, [])) <= set(there):
                score = plain_covers([[[p for p, x in enumerate(there) if x == w] for w in u] for u in units])
                if score:
                    want[i, ref] = score
    got = {(x.query_id, x.legal_ref): x.score for x in text_index.build(unique).covers(q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 100

    from lexweave.operators import vector_index

    chunks = docs.where("content is not null").withColumnsRenamed({"legal_ref": "ref"}).select("ref", "content", F.lit("t").alias("titulo"), F.lit("m").alias("materia"), F.array(F.length("content").cast("double"), F.lit(1.0)).alias("embedding")).dropDuplicates(["ref"])
    asked = asked.where("query_id < 25").select("query_id", F.rpad("pregunta", 5, " ").alias("pregunta"), F.array(F.lit(20.0), F.col("query_id").cast("double")).alias("vector"))
    named = chunks.withColumnRenamed("ref", "legal_ref")
    from lexweave.functions.text import simple_lexemes

    found = [{(x.query_id, x["rank"], x.legal_ref) for x in ask.retrieve(asked, chunks, 3, tokens=simple_lexemes, **how).collect()} for how in ({}, {"words": text_index.build(named), "vectors": vector_index.build(named, "legal_ref")})]
    assert found[0] == found[1] and found[0]


def test_lexical_search_sends_on_few_rows(spark, monkeypatch):
    from collections import Counter

    from lexweave.functions.text import simple_lexemes
    from lexweave.operators import text_index

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(30)], k=r.randint(0, 40)))) for i in range(400)] + [(7, "w3 w3 w0"), (7, None), (500, None), (None, "w1 w29"), (None, "w2")]
    docs = spark.createDataFrame(rows, "legal_ref bigint, content string").repartition(3)
    said = [(i, " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(30)] + [(3, "w0 w4"), (100, ""), (101, None), (None, "w2 w2"), (102, "nowhere")]
    asked = spark.createDataFrame(said, "query_id int, pregunta string")
    held, wanted = {}, {}
    for i, t in rows:
        held.setdefault(i, Counter()).update((t or "").split())
    for q, t in said:
        wanted.setdefault(q, set()).update((t or "").split())
    for cells, hits, pairs in ((1 << 21, 1 << 22, 1 << 20), (70, 5, 20)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "HITS", hits)
        monkeypatch.setattr(search, "TERMS_PER_PASS", pairs)
        for distinct in (False, True):
            want = set()
            for q, terms in wanted.items():
                n = {i: sum(min(1, c[t]) if distinct else c[t] for t in terms) for i, c in held.items()}
                best = sorted((i for i in n if n[i]), key=lambda i: (-n[i], i is not None, i or 0))[:4]
                want |= {(q, i, round(n[i] * 0.1, 9), k + 1) for k, i in enumerate(best)}
            got = [(x.query_id, x.legal_ref, round(x.score, 9), x["rank"]) for x in search.lexical_topk(asked, docs, 4, distinct=distinct).collect()]
            assert len(got) == len(want) and set(got) == want
    # A common word is in every document; four rows for each task and question leave it.
    monkeypatch.setattr(search, "CELLS", 1 << 21)
    common = spark.range(3000).select(F.col("id"), F.split(F.lit("de la ley"), " ").alias("words")).repartition(2)
    terms = spark.range(5).select(F.col("id").alias("q"), F.explode(F.array(F.lit("de"), F.lit("ley"))).alias("term"))
    assert search._candidates(terms, common, 4, False).count() <= 2 * 5 * 4

    # Covers without an index: as with one, and without a shuffle.
    said = ["w0 w1", '"w0 w1"', "w0 w2 -w1", 'w3 "w0 w1" w0', '"w0 w0"', '"w1 w0 w2" -w5', '-"w0 w7" w1', "-w1", "w0 nothing", '"w4"', "w1 w1", "w1 -w1"]
    q = spark.createDataFrame(list(enumerate(said)), "query_id int, said string").withColumn("asked", text_index.web_query(F.col("said")))
    as_set = lambda df: {(x.query_id, x.legal_ref, round(x.score, 9)) for x in df.collect()}
    for own in (docs, docs.where("legal_ref <> 7")):
        for cells in (1 << 21, 30):
            monkeypatch.setattr(text_index, "CELLS", cells)
            assert len(want := as_set(text_index.build(own).covers(q))) > 100 and as_set(text_index.scan_covers(q, own)) == want
    plan = text_index.scan_covers(q, spark.range(9).select(F.col("id").alias("legal_ref"), F.lit("w0 w1").alias("content")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and text_index.scan_covers(q.limit(0), docs, tokens=simple_lexemes).count() == 0


def test_ties_are_cut_where_they_are_found(spark):
    from lexweave.operators.vector_index import best, unit

    docs = spark.createDataFrame([(f"d{i:04d}", [1.0, 2.0, 3.0]) for i in range(2000)] + [("z", [1.0, 2.0, 3.1]), (None, [1.0, 2.0, 3.0])], "legal_ref string, embedding array<double>").coalesce(1)
    questions = spark.createDataFrame([(i, [1.0, 2.0, 3.0 + i / 100]) for i in range(50)], "query_id int, vector array<double>")
    found = search.vector_topk(questions, docs.where("legal_ref is not null"), 5)
    assert {(r.query_id, r.rank): r.legal_ref for r in found.collect()} == {(q, k + 1): (f"d{k:04d}" if q < 5 else "z" if k == 0 else f"d{k - 1:04d}") for q in range(50) for k in range(5)}
    x = unit(np.array([[1.0, 2.0, 3.0]] * 2000))
    q, at, _ = best(x, x[:50], np.arange(2000)[::-1], 5)
    assert len(q) == 250 and sorted(set(at.tolist())) == list(range(1995, 2000))


def test_short_quotes_in_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "QUOTES_PER_PASS", 3)
    docs = spark.createDataFrame([(i, f"uno w{i} dos tres cuatro w{i + 1} fin") for i in range(20)] + [(50, None), (51, "é"), (52, "")], "doc_id int, text string")
    quotes = spark.createDataFrame([(i, f"w{i}") for i in range(12)] + [(100, "dos tres"), (101, "uno w3 dos"), (102, None), (103, "dos"), (104, "dos"), (105, ""), (106, "é"), (107, "s t"), (108, "nowhere at")], "quote_id int, quote string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((q, d) for q, t in [(r.quote_id, r.quote) for r in quotes.collect()] if t is not None for d, x in texts.items() if x is not None and t in x)
    assert sorted((r.quote_id, r.doc_id) for r in search.quote_search(quotes, docs).collect()) == want


def test_few_questions_meet_vectors_where_they_are_read(spark, monkeypatch):
    from lexweave.operators import vector_index

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(200, 6)), np.repeat(r.normal(size=(4, 6)), 50, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [0.0] * 6), (1003, [2.0]), (1004, []), (1005, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 7 = 0 or vec_id in (1001, 1002)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.unionByName(asked.where("query_id = 7"))
    as_list = lambda found: sorted((f.query_id, f.rank, -1 if f.vec_id is None else f.vec_id, f.distance) for f in found.collect())
    # Both are held against products that are computed apart from them.
    u = vector_index.unit(np.concatenate([x, np.zeros((1, 6)), np.ones((1, 6))]))
    ids = np.array([*range(len(x)), 1002, -1])
    for cells in (1 << 22, 700):
        monkeypatch.setattr(vector_index, "MET_CELLS", cells)
        for own in (False, True):
            got = as_list(search.vector_topk(asked, df, 4, id_col="vec_id", skip_self=own))
            by = {}
            for q, _, i, d in got:
                by.setdefault(q, []).append((i, round(d, 9)))
            assert set(by) == {*range(0, len(x), 7), 1001, 1002}
            for q in set(by) - {1001, 7}:
                d = np.round(1 - u @ u[list(ids).index(q)], 12)
                order = [i for i in np.lexsort((ids, d)) if not (own and ids[i] in (q, -1))][:4]
                assert [i for i, _ in by[q]] == ids[order].tolist(), (cells, own, q)
            assert by[1001] == ([(1003, 0.0)] if own else [(1001, 0.0), (1003, 0.0)])
    plan = search.vector_topk(asked, df, 4, id_col="vec_id")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    assert search.vector_topk(asked.limit(0), df, 4, id_col="vec_id").count() == 0


def test_quotes_meet_texts_where_they_are_read(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 18, f"uno w{i} dos  tres cuatro w{i + 1} é fin") for i in range(20)] + [(50, None), (52, "")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "w1 dos  tres cuatro w2"), (2, "uno w1 dos"), (2, "uno w2 dos"), (3, "w1 dos  tres cuatro w2"), (4, "tres cuatro"), (5, None), (6, ""), (7, "no w3 dos  tr"), (8, "é fin"), (9, "w1 dos tres cuatro")], "quote_id int, quote string")
    want = sorted({(q.quote_id, d.doc_id) for q in quotes.collect() for d in docs.collect() if q.quote is not None and d.text is not None and q.quote in d.text})
    found = lambda: search.quote_search(quotes, docs)
    assert "Join" not in found()._jdf.queryExecution().toString()
    assert sorted((r.quote_id, r.doc_id) for r in found().collect()) == want
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 10)  # too many characters: by their longest words
    assert "Join" in found()._jdf.queryExecution().toString()
    assert sorted((r.quote_id, r.doc_id) for r in found().collect()) == want


def test_near_pairs(spark, monkeypatch):
    from lexweave.operators import vector_index

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(900, 6)), np.repeat(r.normal(size=(30, 6)), 20, axis=0) + 0.01 * r.normal(size=(600, 6))])
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, [0.0] * 6), (5001, [1.0])], "id bigint, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    a, b = np.nonzero(np.triu(c >= 0.95, 1))
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    for lists in (1, 40):
        got = sampling.near_pairs(rows, 0.95, lists=lists).collect()
        assert sorted((g.a, g.b) for g in got) == sorted(zip(a.tolist(), b.tolist()))
    # How many pairs are compared, of n * n.
    index = vector_index.build(rows.withColumnRenamed("vector", "v"), "id", "v", 40)
    asked = rows.select(F.col("id").alias("q"), F.col("vector").alias("v"), F.lit(0.05).alias("kth"))
    compared = index._targets(asked, 0, False).join(index.shells, ["list", "shell"]).agg(F.sum("n")).first()[0]
    assert compared < 0.25 * len(x) ** 2
    with pytest.raises(Exception, match="no vector for 7"):
        sampling.near_pairs(spark.createDataFrame([(7, None)], "id bigint, vector array<double>"), 0.5).collect()


def test_near_pairs_of_wide_vectors(spark, monkeypatch):
    from lexweave.operators import vector_index

    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 64))
    x[1400:] = x[7]
    rows = spark.createDataFrame([(i * 3, row.tolist()) for i, row in enumerate(x)] + [(5001, [0.0] * 64), (5002, [1.0]), (5003, [2.0]), (5004, [])], "id bigint, vector array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = {(3 * a, 3 * b): c[a, b] for a, b in zip(*np.nonzero(np.triu(c >= 0.4, 1)))} | {(5002, 5003): 1.0}
    sent = []
    deal = vector_index._dealt
    monkeypatch.setattr(vector_index, "_dealt", lambda *a: sent.append(deal(*a)) or sent[-1])
    for how in ({}, {"MET_BYTES": 200 * 64 * 8, "MET_CELLS": 999, "MET_PAIRS": 50}):
        for name, value in how.items():
            monkeypatch.setattr(vector_index, name, value)
        got = sampling.near_pairs(rows, 0.4).collect()
        assert len(got) == len(want) and all(abs(want[g.a, g.b] - g.cosine) < 1e-12 for g in got)
    # A vector is sent once for each block of 200, however many lists or shells there could be.
    assert sent[-1].count() == 1501 * 8 + 2 and sampling.near_pairs(rows.limit(0), 0.4).count() == 0


def test_greedy_dedupe_of_a_dense_graph(spark, monkeypatch):
    r = random.Random(9)
    edges = {(a, b) for a in range(400) for b in range(a + 1, 400) if r.random() < 0.1}
    kept = set()
    for i in range(400):
        if not any((k, i) in edges for k in kept):
            kept.add(i)
    monkeypatch.setattr(sampling, "components", lambda e: pytest.fail("one component holds everything"))
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    assert {x.id for x in sampling.greedy_dedupe(spark.range(400), df).collect()} == kept
    assert sampling.greedy_dedupe(spark.range(5), df.limit(0)).count() == 5


def test_greedy_dedupe_of_a_long_chain(spark, monkeypatch):
    n = 100_000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    kept = sampling.greedy_dedupe(spark.range(n), chain)
    assert kept.agg(F.count("*"), F.sum(F.col("id") % 2)).first()[:] == (n // 2, 0)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    assert jobs < 150
    r = random.Random(6)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(280)) if a != b})
    roots = {}
    find = lambda x: x if roots.get(x, x) == x else find(roots[x])
    for a, b in edges:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    assert {(x.id, x.root) for x in sampling.components(df).collect()} == {(x, find(x)) for e in edges for x in e}
    kept = set()
    for i in range(300):
        if not any((k, i) in set(edges) for k in kept):
            kept.add(i)
    for most in (1_000_000, 3):  # large components in rounds
        monkeypatch.setattr(sampling, "MAX_COMPONENT", most)
        assert {x.id for x in sampling.greedy_dedupe(spark.range(300), df).collect()} == kept


def test_metrics_of_nothing_are_null(spark):
    cases = spark.createDataFrame([], "id string, refs array<string>")
    pairs = spark.createDataFrame([], "id string, refs array<string>, cited array<string>, abstenida boolean")
    for m in (metrics.recall_at_k(cases, spark.createDataFrame([], "caso_id string, rank int, legal_ref string"), 5), metrics.citation_precision(pairs), metrics.coverage(pairs), metrics.abstain_fn(pairs)):
        row = m.first()
        assert row.valor is None and row.n == 0
    assert metrics.quote_literal(pairs, F.lit(True)).first().valor == 1.0
    assert metrics.statistical_floor(spark.createDataFrame([], "materia string, tipo string")).where("ok").count() == 0


def test_pairing_errors(spark):
    cases = spark.createDataFrame([("a", ["N-1/2000"]), ("b", [])], "id string, refs array<string>")
    predictions = spark.createDataFrame([("a", [], False), ("a", [], False), ("z", [], True)], "caso_id string, refs array<string>, abstenida boolean")
    assert {(r.id, r.problem) for r in metrics.pair_problems(cases, predictions).collect()} == {("a", "repeated"), ("b", "missing"), ("z", "unknown")}
    with pytest.raises(Exception, match="case|prediction"):
        metrics.pair(cases, predictions).collect()


def test_recall_counts_repeated_references(spark):
    cases = spark.createDataFrame([("a", ["N-1/2000#art1", "N-1/2000#art1", "N-1/2000#art2"]), ("b", [])], "id string, refs array<string>")
    rows = spark.createDataFrame([("a", 1, "N-1/2000#art1.3"), ("a", 2, "N-1/2000#art2")], "caso_id string, rank int, legal_ref string")
    got = metrics.recall_at_k(cases, rows, 1).first()
    assert got.valor == pytest.approx(2 / 3) and got.n == 1
    both = evaluate.eval_retrieval(cases, {"x": rows}, (1, 2)).collect()
    assert {(r.reading, r.id): round(r.valor, 3) for r in both} == {("strict", "recall@1"): 0.667, ("article", "recall@1"): 0.667, ("strict", "recall@2"): 1.0, ("article", "recall@2"): 1.0}


def test_bootstrap(spark):
    base = np.array([0, 1, 0, 1, 1, 0, 1, 1.0])
    point, low, high = stats.paired_difference_ci(base, base, 500, 1)
    assert (point, low, high) == (0, 0, 0)
    assert stats.paired_difference_ci(base, 1 - base, 500, 1) == stats.paired_difference_ci(base, 1 - base, 500, 1)
    for wrong in ((base, base[:-1], 10, 1, 0.9), (base[:0], base[:0], 10, 1, 0.9), (base, base, 10, 1, 1.0)):
        with pytest.raises(ValueError):
            stats.paired_difference_ci(*wrong)
    r = random.Random(4)
    rows = [("m", i, r.random(), r.random() + 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "metric string, case_id int, base double, head double")
    a, b = stats.bootstrap_ci(df, 2000, 3).first(), stats.bootstrap_ci_hashed(df, 400, 3).first()
    assert a.low < a.point < a.high and b.low < b.point < b.high
    assert abs(a.low - b.low) < 0.03 and abs(a.high - b.high) < 0.03
    assert stats.regression_flag(stats.bootstrap_ci(df, 200, 3), True).first().regression is False


def test_p95_and_greedy(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    assert df.agg(stats.p95("ms").alias("p")).first().p == pytest.approx(95.05)
    assert df.limit(0).agg(stats.p95("ms").alias("p")).first().p == 0
    r = random.Random(5)
    edges = {(min(a, b), max(a, b)) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(120)) if a != b}
    kept = []
    for i in range(80):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    rows = spark.range(80)
    got = sampling.greedy_dedupe(rows, spark.createDataFrame(sorted(edges), "a bigint, b bigint")).collect()
    assert sorted(x.id for x in got) == kept


def test_quota_and_sample(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "d") for i in range(32)], "source_id int, tema string")
    plan = sampling.quota_plan(rows, 10, 3)
    assert {r.tema: r.quota for r in plan.collect()} == {"a": 4, "b": 3, "c": 3}
    assert sampling.stratified_sample(rows, plan, 1).count() == 10
    with pytest.raises(Exception, match="too few"):
        sampling.stratified_sample(rows, sampling.quota_plan(rows, 40, 4), 1).collect()


def test_golden_validation(spark):
    schema = "id string, pregunta string, respuesta_referencia string, refs array<string>, materia string, tipo string, revisado_por string, revisado_en date"
    import datetime

    day = datetime.date(2024, 1, 1)
    cases = spark.createDataFrame([("1", "q", "a", ["N-1/2000#art1.2"], "m", "positivo", "x", day), ("1", "q", "a", ["N-1/2000#art9"], "m", "positivo", "x", day), ("2", "q", None, [], "m", "positivo", None, None)], schema)
    known = spark.createDataFrame([("N-1/2000#art1",)], "ref string")
    got = {(r.rule, r.id) for r in golden.validate(cases, known).collect()}
    assert {("unique ids", "1"), ("references exist", "1"), ("coherence", "2"), ("statistical floor", "positivos")} <= got
    view = golden.blind_view(spark.createDataFrame([("1", "q", True, "positivo", "r", None, "n", "t"), ("2", "q", False, "negativo", "r", "s", "n", "t")], "id string, pregunta string, a_ciegas boolean, tipo string, ref string, responde string, nota string, texto string"))
    assert [(r.ref, r.texto) for r in view.orderBy("id").collect()] == [(None, None), ("s", "t")]
