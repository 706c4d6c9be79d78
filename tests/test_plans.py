"""Index lifecycle, ingest, sources, the guard as a stream, and every registered query against its SQL."""

from __future__ import annotations

import json
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.plans import index, registry
from lexweave.plans.ingest import ingest, refs_index
from lexweave.sources import files, models
from lexweave.sources.lawxml import blocks_of
from lexweave.streaming.guard import Guard, guard, guard_stream, serve_stream

from .test_operators import LAW

DATA = Path("/root/testdata/sf0.001")


def test_ingest_twice_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("law", LAW)], "doc_id string, xml string")
    embed = lambda rows: rows.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(1.0)))
    ix = index.Index(spark, str(tmp_path))
    runs = [sorted((r.chunk_id, r.content_hash) for r in ingest(ix, blocks_of(docs), F.lit("RD-1/2003"), F.lit("uri"), embed, "m", 2, "apartado-v1").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    assert ix.read("versions").count() == ix.read("aliases").count() == 1
    ingest(ix, blocks_of(docs), F.lit("RD-1/2003"), F.lit("uri"), embed, "m", 2)
    assert ix.chunks().count() == 7 and ix.read("chunks").select("index_version").distinct().count() == 1
    assert ix.read("versions").count() == 2 and index.index_id("m", 2) == "v1-m-2"
    assert index.violations(ix.chunks(), 2).count() == 0
    assert refs_index(ix.chunks()).first().refs[0] == "RD-1/2003#art14bis"
    plan = ix.chunks().select("ref")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "index_version" in plan
    with pytest.raises(Exception, match="no vector"):
        ingest(ix, blocks_of(docs), F.lit("RD-1/2003"), F.lit("uri"), embed, "m", 3)
    with pytest.raises(Exception, match="no index"):
        index.active(ix.read("versions"), ix.read("aliases"), "other").collect()


def test_a_crash_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    ix = index.Index(spark, str(tmp_path))
    schema = "chunk_id string, content string, embedding array<double>, ordinal int, index_version string"

    def put(name, rows, keep_others=False):
        version = spark.range(1).select(F.lit(name).alias("id"), F.lit("m").alias("embedding_model"), F.lit(2).alias("dim"))
        alias = spark.range(1).select(F.lit("active").alias("alias"), F.lit(name).alias("index_version"), F.lit("chunks").alias("physical_table"), F.current_timestamp().alias("switched_at"))
        ix.put(spark.createDataFrame([(i, t, [1.0, 2.0], 0, name) for i, t in rows], schema), version, alias, keep_others)

    state = lambda: sorted((r.chunk_id, r.content, r.index_version) for r in ix.read("chunks").collect())
    put("v1", [("a", "one"), ("b", "two")])
    first = state()
    for broken in ("_commit", "_write"):
        with monkeypatch.context() as m:
            calls = []

            def fail(self, *args, was=getattr(index.Index, broken), broken=broken):
                calls.append(args)
                if broken == "_commit" or len(calls) == 3:  # chunks and versions are written, aliases are not
                    raise OSError("lost")
                return was(self, *args)

            m.setattr(index.Index, broken, fail)
            with pytest.raises(OSError, match="lost"):
                put("v2", [("c", "three")])
        assert state() == first and sorted(r.chunk_id for r in ix.chunks().collect()) == ["a", "b"]
    put("v2", [("c", "three")], keep_others=True)
    assert [r.chunk_id for r in ix.chunks().collect()] == ["c"] and len(state()) == 3
    kept = ix._now()["chunks"]["v1"]
    put("v2", [("d", "four")], keep_others=True)
    assert ix._now()["chunks"]["v1"] == kept  # another version's part isn't written again
    put("v3", [("a", "uno")], keep_others=True)  # a chunk moves
    assert state() == [("a", "uno", "v3"), ("b", "two", "v1"), ("c", "three", "v2"), ("d", "four", "v2")]
    seen = ix._numbers()
    with pytest.raises(OSError, match="another writer"):
        ix._commit(seen[:-1], {})
    put("v3", [("e", "five")])
    assert state() == [("a", "uno", "v3"), ("e", "five", "v3")] and len(ix._numbers()) == 2


def test_rows_conform_to_their_table(spark):
    rows = spark.createDataFrame([("active", "v1", "chunks", 3)], "alias string, index_version string, physical_table string, more int")
    assert index.conform(rows, "aliases").columns == ["alias", "index_version", "physical_table", "switched_at", "more"]
    assert index.conform(rows, "aliases").first().switched_at is not None
    with pytest.raises(ValueError, match="no column"):
        index.conform(rows.drop("alias"), "aliases")
    with pytest.raises(Exception, match="breaks its rule"):
        index.conform(rows.withColumn("alias", F.lit(None).cast("string")), "aliases").collect()


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    from lexweave.sources.models import scored_by

    folder = str(tmp_path)

    def load():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda questions, texts: [len(q) + len(t) / 1000 for q, t in zip(questions, texts)]

    rows = spark.createDataFrame([("q" * i, "t" * 600) for i in range(1, 50)], "pregunta string, content string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert sorted(r.points for r in scored_by(load)(rows).collect()) == [i + 0.5 for i in range(1, 50)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 1


def test_a_question_needs_a_word(spark):
    from lexweave.plans import ask

    chunks = spark.createDataFrame([("N-1/2000#art1", "texto", "t", [1.0], "a")], "ref string, content string, titulo string, embedding array<double>, materia string")
    with pytest.raises(Exception, match="without a word"):
        ask.retrieve(spark.createDataFrame([("q", "¿¿!!", [1.0])], "query_id string, pregunta string, vector array<double>"), chunks).collect()


def test_ask(spark):
    from lexweave.operators.goals import nest, select_path
    from lexweave.plans import ask

    chunks = spark.createDataFrame([("N-1/2000#art1", "El permiso caduca a los diez años de expedirse.", "t", [1.0, 0.0], "a"), ("N-1/2000#art2", "La velocidad máxima es de cien.", "t", [0.0, 1.0], "b")], "ref string, content string, titulo string, embedding array<double>, materia string")
    questions = spark.createDataFrame([("q1", "¿Cuándo caduca el permiso?", [0.9, 0.1]), ("q2", "velocidad máxima", [0.1, 0.9])], "query_id string, pregunta string, vector array<double>")
    assert {(r.query_id, r.legal_ref[-1]) for r in ask.ask(questions, chunks, 1).collect()} == {("q1", "1"), ("q2", "2")}
    found = ask.retrieve(questions, chunks, 2)
    assert {(r.query_id, r.legal_ref[-1]) for r in found.where("rank = 1").collect()} == {("q1", "1"), ("q2", "2")}
    only = ask.retrieve(questions.where("query_id = 'q2'"), chunks.where("materia = 'b'"), 2, subject="a")
    assert [r.legal_ref for r in only.collect()] == ["N-1/2000#art2"]
    draft = lambda rows, attempt: rows.withColumn("draft", F.when(F.col("prompt").contains("[1] (1)"), F.lit("CITAS\n[[REF:1]] §1\nRESPUESTA\nSí.")))
    got = ask.ask_cited(questions, found, draft).collect()
    assert {r.salida for r in got} == {"responder"} and {r.answer for r in got} == {"Sí."}
    with pytest.raises(Exception, match="3 to 500"):
        ask.ask(questions.withColumn("pregunta", F.lit("x")), chunks).collect()
    with pytest.raises(ValueError):
        ask.ask(questions, chunks, 21)
    doc = spark.createDataFrame([('{"a":{"m":[{"id":"x","v":{"w":1}},{"id":"y","v":2}]}}',)], "d string")
    row = doc.select(select_path(F.col("d"), "a.m[id=x].v.w").alias("w"), select_path(F.col("d"), "a.m[id=z].v").alias("z"), F.to_json(nest({"b.c": F.lit(1), "a": F.lit(2)})).alias("n")).first()
    assert tuple(row) == ("1", None, '{"a":2,"b":{"c":1}}')


def test_retrieve_finds_inflected_words(spark):
    from lexweave.functions.text import simple_lexemes
    from lexweave.plans import ask

    rows = [("N-1/2000#art1", "Los vehículos tienen luces.", "t", [0.0, 1.0], "a"), ("N-1/2000#art2", "La norma de la vía y de los peatones.", "t", [1.0, 0.0], "a"), ("N-1/2000#art3", "Se conducirá con cuidado.", "t", [0.0, -1.0], "a")]
    chunks = spark.createDataFrame(rows, "ref string, content string, titulo string, embedding array<double>, materia string")
    questions = spark.createDataFrame([("q1", "de la luz del vehiculo", None), ("q2", "¿Quien conducira?", None), ("q3", "de la y de los", None)], "query_id string, pregunta string, vector array<double>")
    found = lambda **how: sorted((r.query_id, r.legal_ref[-1]) for r in ask.retrieve(questions, chunks, 3, **how).collect())
    assert found() == [("q1", "1"), ("q2", "3")]  # stop words find nothing
    assert found(tokens=simple_lexemes) == [("q1", "2"), ("q3", "1"), ("q3", "2")]


def test_bootstrap_queries_take_the_references_resamples(spark, monkeypatch):
    taken = []
    for name in ("bootstrap_ci", "bootstrap_ci_hashed"):
        found = spark.createDataFrame([("quality", 0.0, -1.0, 1.0, 1)], "metric string, point double, low double, high double, n bigint")
        monkeypatch.setattr(registry.stats, name, lambda scores, n, seed, found=found: taken.append(n) or found)
        registry.queries()[name](spark, str(DATA))
    assert taken == [10_000, 10_000]


def test_recordings_and_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "content string").withColumn("embedding", F.array(F.lit(1.0)))
    recording = models.record_embeddings(texts, "m")
    assert models.recorded_embedder(recording, "m")(texts.select("content")).count() == 2
    with pytest.raises(Exception, match="no recorded embedding"):
        models.recorded_embedder(recording, "other")(texts.select("content")).collect()
    rows = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    cache = spark.createDataFrame([("k1", "old")], "key string, value string")
    full, new = models.through_cache(rows, cache, lambda m: m.withColumn("value", F.lit("new")))
    assert sorted((r.key, r.value) for r in full.collect()) == [("k1", "old"), ("k2", "new"), ("k2", "new")] and new.count() == 1
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",), (": ping",)], "x string")
    assert [r.t for r in lines.select(models.chat_delta(F.col("x")).alias("t")).collect()] == ["hi", "", ""]


def test_http_ports(spark):
    def post(url, body, timeout):
        if url.endswith("embeddings"):
            return {"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        return {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}, "finish_reason": "stop"}]}

    rows = spark.createDataFrame([("abc", "say")], "content string, prompt string")
    assert models.http_embedder("http://x", "m", 2, post=post)(rows).first().embedding == [3.0, 0.0]
    assert models.http_generator("http://x", "m", post=post)(rows, 0).first().draft == "SAY"
    with pytest.raises(Exception, match="wide"):
        models.http_embedder("http://x", "m", 3, post=post)(rows).collect()


def test_files(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("source_id;pregunta;tema;pct_fallo\n1;¿Qué?;t;10,5\n2;No;t;x\n", encoding="utf-8")
    assert [r.pct_fallo for r in files.read_bank(spark, str(tmp_path / "bank.csv")).orderBy("source_id").collect()] == [10.5, None]
    (tmp_path / "cases.jsonl").write_text('{"id":"1","refs":["N-1/2000"],"version":1}\nnot json\n', encoding="utf-8")
    got = files.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()
    assert [r.id for r in got] == ["1", None] and got[1]._bad == "not json"
    props = spark.createDataFrame([("a", json.dumps({"_x": {}, "1": {"ref": "old"}, "2": {"ref": "two"}})), ("b", json.dumps({"1": {"ref": "new"}}))], "path string, value string")
    assert {r.id: r.ref for r in files.proposals_of(props).collect()} == {"1": "new", "2": "two"}
    seal = files.write_cases(spark.createDataFrame([("2", 1), ("1", 2)], "id string, n int"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    import hashlib

    assert seal == hashlib.sha256(part.read_bytes()).hexdigest() and part.read_text().startswith('{"id":"1"')


CASES = {
    "plain": (2, ["Hello ", "world"]),
    "split": (2, ["see [[RE", "F:", "2", "]] ok"]),
    "bad": (2, ["see [[REF:", "9]] no", " more"]),
    "zero": (0, ["x [[REF:1]] y"]),
    "mixed": (3, ["a [[REF:1]]b[[REF:3]]c[[REF:4]]d"]),
    "held": (2, ["text [[REF:1"]),
    "bracket": (2, ["a [ b [[ c [[REFX"]),
}


def test_guard_batch_equals_token_by_token(spark):
    rows = [(k, 0, i, t, n) for k, (n, tokens) in CASES.items() for i, t in enumerate(tokens)]
    got = {r.request_id: r for r in guard(spark.createDataFrame(rows, "request_id string, attempt int, seq int, token string, n_sources int")).collect()}
    for k, (n, tokens) in CASES.items():
        g = Guard(n)
        pieces = [g.take(t) for t in tokens]
        assert got[k].emitted == "".join(p for p, _ in pieces), k
        assert got[k].holes == [h for _, hs in pieces for h in hs] and got[k].state == g.state
    assert got["bad"].emitted == "see " and got["bad"].state == "retractado" and got["held"].emitted == "text "


def test_guard_stream_equals_batch(spark, tmp_path):
    schema = "request_id string, attempt int, seq bigint, token string, n_sources int, is_last boolean"
    rows = [(k, 0, i, t, n, i == len(tokens) - 1) for k, (n, tokens) in CASES.items() for i, t in enumerate(tokens)]
    # Later tokens come in an earlier file.
    for part in (1, 0):
        spark.createDataFrame([r for r in rows if r[2] % 2 == part], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = guard_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    served = {r.request_id: r for r in serve_stream(spark.read.parquet(f"{tmp_path}/out")).collect()}
    batch = {r.request_id: r for r in guard(spark.createDataFrame(rows, schema)).collect()}
    for k in CASES:
        assert served[k].emitted == batch[k].emitted and served[k].state == batch[k].state and served[k].done, k
    # Attempts that are over hold nothing but a mark.
    early = spark.read.format("statestore").option("stateVarName", "early").load(f"{tmp_path}/cp")
    assert early.count() == 0
    marks = spark.read.format("statestore").option("stateVarName", "at").load(f"{tmp_path}/cp").select("value.*").select("value.*" if "value" in spark.read.format("statestore").option("stateVarName", "at").load(f"{tmp_path}/cp").select("value.*").columns else "*").collect()
    assert len(marks) == len(CASES) and all(m.over and m.buffer == "" for m in marks)


def _norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else ("%.6g" % r[i] if isinstance(r[i], (float, Decimal)) else str(r[i])) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _norm(df.columns, rows) == _norm(columns, got.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
