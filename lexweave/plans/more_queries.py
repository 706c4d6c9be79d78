"""Further queries of the registry: operators that the first ones reach only in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text, vectors
from ..operators import golden, metrics, sampling, search, structure
from ..sources import lawxml, models
from . import evaluate, index
from .registry import _QUERIES, _SQL, LEXICAL_CTE, QUOTA, VERIFY_CTE, _cases, _lexical, _predictions, _requests, _rounded, greedy_cte, query, table


@query("SELECT doc_id, sha256(trim(strip_accents(lower(text)))) AS plain FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_accents(F.col("text")), 256).alias("plain"))


# Words and the forms that a search in Spanish compares.
LEXEMES = {"Vehículos": "vehicul", "VEHÍCULO": "vehicul", "circulación": "circul", "circular": "circul", "permisos": "permis", "Permiso": "permis", "señales": "senal", "señal": "senal", "conductores": "conductor", "conducir": "conduc"}


@query("SELECT doc_id, " + " || ' ' || ".join(f"list_extract([{', '.join(repr(v) for v in LEXEMES.values())}], CAST((doc_id + {k}) % {len(LEXEMES)} + 1 AS INTEGER))" for k in (0, 3)) + " AS lexemes FROM documents")
def spanish_lexemes(spark, sf_dir):
    word = lambda k: F.element_at(F.array(*map(F.lit, LEXEMES)), ((F.col("doc_id") + k) % len(LEXEMES) + 1).cast("int"))
    line = F.concat(F.lit("el "), word(0), F.lit(", de la "), word(3), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.spanish_lexemes(line), " ").alias("lexemes"))


@query(f"WITH docs AS (SELECT doc_id, {' || chr(32) || '.join(f'list_extract([{chr(44).join(repr(v) for v in LEXEMES.values())}], CAST((doc_id + {k}) % {len(LEXEMES)} + 1 AS INTEGER))' for k in (0, 3))} AS x FROM documents), q AS (SELECT * FROM (VALUES (0, 'vehicul'), (1, 'senal'), (1, 'permis'), (2, 'conduc')) AS t(query_id, term)), "
       "h AS (SELECT query_id, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(x, ' ')) AS term FROM docs) JOIN q USING (term) GROUP BY 1, 2) SELECT query_id, doc_id, round(n * 0.1, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 10")  # fmt: skip
def lexical_topk_spanish(spark, sf_dir):
    word = lambda k: F.element_at(F.array(*map(F.lit, LEXEMES)), ((F.col("doc_id") + k) % len(LEXEMES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" el "), word(0), F.lit(", de la "), word(3)).alias("content"))
    asked = spark.range(3).select(F.col("id").cast("int").alias("query_id"), F.element_at(F.array(F.lit("¿Qué vehiculos?"), F.lit("las SEÑALES y el permiso"), F.lit("conduciendo")), (F.col("id") + 1).cast("int")).alias("pregunta"))
    found = search.lexical_topk(asked, docs, 10, id_col="doc_id", tokens=text.spanish_lexemes)
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {LEXICAL_CTE} SELECT query_id, legal_ref, round(1.0 - score, 6) AS distance FROM lexical")
def lexical_distance(spark, sf_dir):
    return _lexical(spark, sf_dir, False).select("query_id", "legal_ref", F.round(search.lexical_distance(F.col("score")), 6).alias("distance"))


@query("""SELECT doc_id, '{"chunker_id":"' || lang || '","fecha_vigencia":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"2020"' END || ',"id_norma_version":"' || source || '"}' AS metadata FROM documents""")
def metadata_json(spark, sf_dir):
    date = F.when(F.col("doc_id") % 3 != 0, F.lit("2020"))
    return table(spark, sf_dir, "documents").select("doc_id", index.metadata(F.col("lang"), F.col("source"), date).alias("metadata"))


@query("SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 1")
def random_question(spark, sf_dir):
    return sampling.random_case(table(spark, sf_dir, "documents").select("doc_id"), 11, "doc_id")


@query(f"WITH g AS ({_SQL['goal_predicate']}) SELECT id, passed FROM g WHERE id <= coalesce((SELECT min(id) FROM g WHERE NOT passed), id)")
def goal_gate(spark, sf_dir):
    return metrics.gate(_QUERIES["goal_predicate"](spark, sf_dir)).select("id", "passed")


@query("""WITH b AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT source AS file, count(*) AS n FROM documents WHERE lang <> 'es' AND source <> 'src3' GROUP BY 1)
SELECT file, b.n AS was, coalesce(a.n, 0) AS "is" FROM b LEFT JOIN a USING (file) WHERE coalesce(a.n, 0) < b.n""")
def inventory_regression(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "file")
    count = lambda x: x.groupBy("file").agg(F.count("*").alias("n"))
    return metrics.fallen(count(d.where("lang <> 'es' and file <> 'src3'")), count(d))


@query("""WITH l AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || repeat('x', 50) AS t FROM part),
w AS (SELECT p_partkey, list_reduce(list_transform(flatten(list_transform(string_split(t, ' '), lambda w: CASE WHEN length(w) <= 24 THEN [w] ELSE list_transform(range(0, (length(w) + 23) // 24), lambda i: substr(w, i * 24 + 1, 24)) END)), lambda w: [w]),
  lambda acc, w: CASE WHEN acc[len(acc)] = '' OR length(acc[len(acc)]) + 1 + length(w[1]) <= 24 THEN list_slice(acc, 1, len(acc) - 1) || [CASE WHEN acc[len(acc)] = '' THEN w[1] ELSE acc[len(acc)] || ' ' || w[1] END] ELSE acc || w END) AS ls FROM l)
SELECT p_partkey, array_to_string(ls, chr(10)) || chr(10) || 'end' AS wrapped FROM w""")
def wrap_text(spark, sf_dir):
    line = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), F.lit("x" * 50), F.lit("\nend"))
    return table(spark, sf_dir, "part").select("p_partkey", text.wrap(line, 24).alias("wrapped"))


@query(r"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 2 THEN '«' || regexp_replace(text, '\s+$', '') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS quote FROM conversations WHERE length(trim(text)) > 0 AND NOT regexp_matches(trim(text), '^["''«“]')""")
def unquote(spark, sf_dir):
    t, i = F.col("text"), F.col("conv_id") % 4
    given = F.when(i == 0, F.concat(F.lit(" «"), t, F.lit("» "))).when(i == 1, F.concat(F.lit('"'), t, F.lit('"'))).when(i == 2, F.concat(F.lit("«"), t)).otherwise(t)
    return table(spark, sf_dir, "conversations").where("length(trim(text)) > 0 and not trim(text) rlike '^[\"\\'«“]'").select("conv_id", "turn", C.unquote(given).alias("quote"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT::VARCHAR), ',') || ']' AS literal FROM embeddings")
def vector_literal(spark, sf_dir):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_literal(whole).alias("literal"))


@query(f"WITH {VERIFY_CTE} SELECT conv_id AS request_id, CASE WHEN conv_id % 6 BETWEEN 1 AND len(k) THEN 'N-1/2000#art' || k[conv_id % 6] END AS ref FROM s")
def resolve_hole(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", C.resolve_hole((F.col("request_id") % 6).cast("int"), F.col("sources")).alias("ref"))


@query("SELECT conv_id, turn, contains(upper(CASE WHEN turn % 2 = 0 THEN text || ' no puedo responder' ELSE text END), 'NO PUEDO RESPONDER') AS cannot FROM conversations")
def self_abstain(spark, sf_dir):
    t = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" no puedo responder"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.says_cannot(t).alias("cannot"))


@query("SELECT item_id, 'Q: ' || text || chr(10) || 'S: [1] {pregunta}' AS prompt FROM benchmark")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", C.render_prompt("---\nversion: 1\n---\nQ: {pregunta}\nS: {fuentes}", F.col("text"), F.lit("[1] {pregunta}")).alias("prompt"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def filter_usable(spark, sf_dir):
    bank = table(spark, sf_dir, "documents").withColumn("depende_imagen", F.when(F.col("lang").isin("en", "fr"), "no").otherwise("si"))
    return sampling.usable(bank).select("doc_id")


@query("SELECT 'v' || c_custkey AS index_version, 'chunks' AS physical_table, c_mktsegment AS embedding_model, CAST(c_nationkey AS INTEGER) AS dim FROM customer ORDER BY c_custkey DESC LIMIT 1")
def catalog_active(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    versions = c.select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("embedding_model"), F.col("c_nationkey").cast("int").alias("dim"))
    moves = c.select(F.lit("active").alias("alias"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("index_version"), F.lit("chunks").alias("physical_table"), F.col("c_custkey").alias("switched_at"))
    return index.active(versions, index.point_alias(moves.limit(0), moves))


@query("SELECT vec_id FROM embeddings")
def index_binding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    own = e.limit(1).select(F.lit("m").alias("embedding_model"), F.size("embedding").alias("dim"))
    asked = e.select("vec_id", F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    return index.bound_to_index(asked, own).select("vec_id")


@query("SELECT o_orderkey, o_custkey::VARCHAR AS key, CASE WHEN c_acctbal > 0 THEN 'held' ELSE 'made' END AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def cache_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    cache = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), F.lit("held").alias("value"))
    return models.through_cache(rows, cache, lambda missing: missing.withColumn("value", F.lit("made")))[0]


# The metrics of answers, one after another, as each of them has it.
_ANSWERS = ("citation_precision", "citation_precision_article", "hallucination", "coverage", "abstain_fp", "abstain_fn")


@query(" UNION ALL ".join(f"SELECT * FROM ({_SQL[name]})" for name in _ANSWERS))
def eval_answers(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return _rounded(evaluate.eval_answers(cases, _predictions(spark, sf_dir), cases.select(F.explode("refs").alias("ref"))))


_REASONS = "SELECT CASE WHEN conv_id % 3 = 0 THEN 'sin_citas' WHEN conv_id % 3 = 1 THEN 'quote_no_literal' ELSE 'sin_motivo_declarado' END AS m, count(*) AS n FROM conversations GROUP BY 1"


@query(" UNION ALL ".join(f"SELECT * FROM ({_SQL[name]})" for name in _ANSWERS) + f" UNION ALL SELECT 'motivo:' || m, round(n::DOUBLE / sum(n) OVER (), 9), n FROM ({_REASONS})")
def eval_agent(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    i = F.col("conv_id") % 3
    results = table(spark, sf_dir, "conversations").select(F.when(i == 0, "sin_citas").when(i == 1, "quote_no_literal").alias("motivo"))
    return _rounded(evaluate.eval_agent(cases, _predictions(spark, sf_dir), cases.select(F.explode("refs").alias("ref")), results))


@query("SELECT p_partkey::VARCHAR AS id, p_brand AS embedding_model, p_size::INTEGER AS dim, 'cosine' AS distance, p_type AS chunker_id, '2024' AS corpus_snapshot, 'chunks' AS physical_table, p_name AS more FROM part")
def schema_conform(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("more"), F.col("p_size").alias("dim"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("embedding_model"), F.lit("cosine").alias("distance"), F.col("p_type").alias("chunker_id"), F.lit(2024).alias("corpus_snapshot"), F.lit("chunks").alias("physical_table"))
    return index.conform(p, "versions").drop("created_at")


@query("""WITH c AS (SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'en' THEN 'negativo' ELSE 'positivo' END AS tipo, n_chars % 2 AS refs, source, lang, doc_id FROM documents UNION ALL SELECT '0', 'positivo', 1, 'src0', 'de', 0),
f AS (SELECT count(*) FILTER (tipo = 'positivo')::DOUBLE AS p, count(*) FILTER (tipo = 'negativo')::DOUBLE AS m, count(*) AS n, (SELECT count(*) FROM (SELECT source FROM c GROUP BY 1 HAVING count(*) >= 20))::DOUBLE AS s FROM c)
SELECT 'coherence' AS rule, id, 'negative with references' AS detail FROM c WHERE tipo = 'negativo' AND refs > 0 UNION ALL SELECT 'coherence', id, 'positive without references' FROM c WHERE tipo = 'positivo' AND refs = 0
UNION ALL SELECT 'coherence', id, 'no reviewer' FROM c WHERE source = 'src3' UNION ALL SELECT 'coherence', id, 'positive without an answer' FROM c WHERE tipo = 'positivo' AND lang = 'fr'
UNION ALL SELECT 'unique ids', id, count(*)::VARCHAR FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'references exist', id, 'N-1/2000#art' || doc_id || '.1' FROM c WHERE refs > 0 AND doc_id % 5 <> 0
UNION ALL SELECT 'statistical floor', r.rule, r.v::VARCHAR FROM (SELECT unnest([struct_pack(rule := 'positivos', v := p, least := 150.0::DOUBLE), struct_pack(rule := 'negativos', v := m, least := 40.0::DOUBLE), struct_pack(rule := 'fraccion_negativos', v := m / n, least := 0.15::DOUBLE), struct_pack(rule := 'materias', v := s, least := 6.0::DOUBLE)]) AS r FROM f) WHERE r.v < r.least""")
def golden_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = d.select("doc_id", "lang", "source", "n_chars")
    again = own.limit(1).select(F.lit(0).cast("bigint").alias("doc_id"), F.lit("de").alias("lang"), F.lit("src0").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    rows = own.unionByName(again.select(*[F.col(c).cast(own.schema[c].dataType).alias(c) for c in own.columns]))
    ref = F.concat(F.lit("N-1/2000#art"), F.col("doc_id").cast("string"), F.lit(".1"))
    cases = rows.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "negativo").otherwise("positivo").alias("tipo"), F.when(F.col("n_chars") % 2 > 0, F.array(ref)).otherwise(F.expr("cast(array() as array<string>)")).alias("refs"), F.when(F.col("lang") != "fr", F.lit("yes")).alias("respuesta_referencia"), F.when(F.col("source") != "src3", F.lit("someone")).alias("revisado_por"), F.current_date().alias("revisado_en"), F.col("source").alias("materia"))
    known = d.where("doc_id % 5 = 0").select(F.concat(F.lit("N-1/2000#art"), F.col("doc_id").cast("string")).alias("ref"))
    return golden.validate(cases, known)


@query(f"""WITH RECURSIVE {QUOTA}, wide AS (SELECT source, quota, least(available, CAST(ceil(quota * 1.25) AS BIGINT)) AS more FROM plan),
drawn AS (SELECT doc_id AS id, source FROM (SELECT doc_id, d.source, more, row_number() OVER (PARTITION BY d.source ORDER BY md5('7|' || d.source || '|' || doc_id), doc_id) AS rn FROM documents d JOIN wide ON wide.source = d.source) WHERE rn <= more),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.doc_id + 20 = b.doc_id), near AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM drawn) AND b IN (SELECT id FROM drawn)), {greedy_cte('drawn', 'near')}
SELECT doc_id, source FROM (SELECT drawn.id AS doc_id, drawn.source, quota, row_number() OVER (PARTITION BY drawn.source ORDER BY md5('7|' || drawn.source || '|' || drawn.id), drawn.id) AS rn FROM kept JOIN drawn USING (id) JOIN plan ON plan.source = drawn.source) WHERE rn <= quota""")
def queue_oversample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    ids = d.select("doc_id")
    plan = sampling.quota_plan(d, 100, 7, "source")
    wide = plan.withColumn("quota", F.least("available", F.ceil(F.col("quota") * 1.25).cast("bigint")).cast("int"))
    drawn = sampling.stratified_sample(d, wide, 7, "source", "doc_id")
    # Documents twenty apart count as near; pairs go with the rows that are drawn.
    pairs = ids.join(ids.select((F.col("doc_id") - 20).alias("a")), F.col("doc_id") == F.col("a")).select("a", (F.col("a") + 20).alias("b"))
    near = pairs.join(drawn.select(F.col("doc_id").alias("a")), "a", "left_semi").join(drawn.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    return sampling.queue(d, near, 100, 7, 7, 1.25, "source", "doc_id").select("doc_id", "source")


# Each document as a law: a preamble, two titles with an article each, whose last version counts and whose nested paragraphs don't; every tenth is unsafe.
_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"


def _laws(spark, sf_dir):
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    i = F.col("doc_id").cast("string")
    article = lambda n, text_: F.concat(F.lit(f'<bloque id="a{n}" tipo="precepto" titulo="Artículo '), F.when((F.col("doc_id") % 2 == 0) | F.lit(n == 1), "1").otherwise("2"), F.lit(' "><version id_norma="OLD"><p class="parrafo">Old.</p></version><version id_norma="N'), i, F.lit('" fecha_vigencia="20200101"><p class="articulo">Artículo. Rubric.</p><p class="parrafo">'), text_, F.lit(' </p><blockquote><p class="parrafo">Nested.</p></blockquote></version></bloque>'))
    head = lambda n: F.lit(f'<bloque id="t{n}" tipo="encabezado" titulo="TÍTULO {"I" * n}"><version id_norma="N"><p class="titulo_num">T</p></version></bloque>')
    start = F.when(F.col("doc_id") % 10 == 0, '<!DOCTYPE x [<!ENTITY e "e">]>').otherwise("")
    xml = F.concat(start, F.lit("<response><data><texto>"), head(1), article(1, F.concat(body, F.lit("."))), head(2), article(2, F.lit("<strong>So</strong> it is")), F.lit("</texto></data></response>"))
    return lawxml.blocks_of(table(spark, sf_dir, "documents").select(i.alias("doc_id"), xml.alias("xml")))


@query(f"""WITH d AS (SELECT doc_id::VARCHAR AS id, doc_id % 2 = 0 AS even, doc_id % 10 = 0 AS bad, {_PLAIN} || '.' AS body FROM documents),
b AS (SELECT id, unnest([struct_pack(pos := 0, t := 'TÍTULO I', n := 'N', c := 'titulo_num', x := 'T'), struct_pack(pos := 1, t := 'Artículo 1', n := 'N' || id, c := 'articulo|parrafo', x := 'Artículo. Rubric.|' || body), struct_pack(pos := 2, t := 'TÍTULO II', n := 'N', c := 'titulo_num', x := 'T'),
  struct_pack(pos := 3, t := CASE WHEN even THEN 'Artículo 1' ELSE 'Artículo 2' END, n := 'N' || id, c := 'articulo|parrafo', x := 'Artículo. Rubric.|So it is')]) AS b FROM d WHERE NOT bad)
SELECT id AS doc_id, b.pos AS pos, b.t AS titulo, b.n AS id_norma, b.c AS classes, sha256(b.x) AS texts, NULL::VARCHAR AS error FROM b UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, 'DTD or entities' FROM d WHERE bad""")
def scan_law_xml(spark, sf_dir):
    part = lambda name: F.array_join(F.transform("paras", lambda p: p[name]), "|")
    return _laws(spark, sf_dir).select("doc_id", "pos", "titulo", F.col("version.id_norma").alias("id_norma"), part("class").alias("classes"), F.sha2(part("text"), 256).alias("texts"), "error")


@query(f"""WITH d AS (SELECT doc_id::VARCHAR AS id, doc_id % 2 = 0 AS even, {_PLAIN} || '.' AS body FROM documents WHERE doc_id % 10 <> 0)
SELECT id AS doc_id, CASE WHEN even THEN 'ti-1' ELSE '1' END AS articulo, 'TÍTULO I' AS titulo, 'Rubric.' AS rubrica, true AS vigente FROM d UNION ALL SELECT id, CASE WHEN even THEN 'tii-1' ELSE '2' END, 'TÍTULO II', 'Rubric.', true FROM d""")
def title_collisions(spark, sf_dir):
    found = structure.units(_laws(spark, sf_dir), F.lit("N-1/2000"))
    return found.select("doc_id", F.regexp_replace("articulo", "^rd-", "").alias("articulo"), "titulo", F.regexp_replace("rubrica", r"^Artículo\. ", "").alias("rubrica"), "vigente")
