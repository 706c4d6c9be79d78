"""The queries that the driver runs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .bpe_automaton import bpe_round_trip
from .common import read_table
from .embedding_dedup import embedding_dedup
from .maxent_lm import lm_scores
from .mixing import BLOCK_ROWS, ROWS_PER_BUCKET, mix_sources
from .ngram_join import ngram_join
from .quality import quality_classifier
from .ranked_search import lexical_search
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .topk_search import topk_search
from .url_filters import url_filter
from .vector_codes import books_sha256, hexadecimal, vector_codes

#: Integer target weights: every fourth source counts most.
WEIGHTS = {f"src{i}": 4 - i % 4 for i in range(20)}

# The rules of the contract, as host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS).select("doc_id", "source", "block", "slot", "position")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(read_table(spark, sf_dir, "embeddings"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read_table(spark, sf_dir, "labels"), ["doc_id", "lang"])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.secret_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    hidden = F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.sha2(s["text"], 256).alias("sha256"), s["score"].alias("score")))
    return found.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), hidden.alias("secrets"), F.sha2("redacted", 256).alias("redacted_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", hexadecimal(F.col("codes")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_substring_dedup, op3_bpe_automaton, op4_embedding_dedup, op5_topk_search, op6_url_filters, op7_quality, op8_secrets, op9_token_counts, op10_ngram_join, op11_lm_scores, op12_vector_codes, op13_ranked_search)}


#: The pieces of a url, as the contract has them.
_URL_SQL = """
SELECT page_id, host, path,
  CASE WHEN a THEN 'example.com/en/7' WHEN b THEN 'example.net/de/8' WHEN c THEN 'com/en/' WHEN d THEN 'net/de/' WHEN e THEN 'org/es/' END AS rule,
  CASE WHEN a THEN 'allow' WHEN b THEN 'block' WHEN c THEN 'block' WHEN d THEN 'allow' WHEN e THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *, (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/7') AS a,
    (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/de/8') AS b,
    (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/en/') AS c,
    (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/de/') AS d,
    (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/es/') AS e
  FROM (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
  )
)
"""

# The schedule slot by slot: of the blocks that are released the one that is due first.
_MIXING_SQL = f"""
WITH RECURSIVE w AS (SELECT * FROM (VALUES {", ".join(f"('s{s}', {w})" for s, w in WEIGHTS.items())}, ('o', 1)) AS t(k, w)),
d AS (SELECT doc_id, source, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN 's' || source ELSE 'o' END AS k, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
z AS (SELECT k, w, count(*) AS n, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks, (count(*) + {ROWS_PER_BUCKET - 1}) // {ROWS_PER_BUCKET} AS buckets, row_number() OVER (ORDER BY k) AS i FROM d JOIN w USING (k) GROUP BY k, w),
r AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY h % buckets, h, doc_id) - 1 AS row FROM d JOIN z USING (k)),
l AS (SELECT list(w ORDER BY i) AS ws, list(blocks ORDER BY i) AS bs, count(*) AS m FROM z),
walk(slot, s, given, rest, pick) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(bs, lambda x: 0::BIGINT), bs, NULL::BIGINT FROM l
  UNION ALL
  SELECT slot + 1, CASE WHEN rest[p] = 1 THEN 0 ELSE s + 1 END, CASE WHEN rest[p] = 1 THEN list_transform(given, lambda x: 0::BIGINT) ELSE list_transform(given, lambda x, j: x + (j = p)::BIGINT) END, list_transform(rest, lambda x, j: x - (j = p)::BIGINT), p
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, m + 1), lambda j: rest[j] > 0 AND (given[j] * total) // ws[j] <= s), lambda j: struct_pack(due := ((given[j] + 1) * total + ws[j] - 1) // ws[j], j := j))).j AS p
    FROM (SELECT walk.*, ws, m, list_sum(list_transform(range(1, m + 1), lambda j: CASE WHEN rest[j] > 0 THEN ws[j] ELSE 0 END))::BIGINT AS total FROM walk, l WHERE list_sum(rest) > 0))
),
placed AS (SELECT k, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM walk JOIN z ON z.i = pick),
sized AS (SELECT k, slot, block, least({BLOCK_ROWS}, n - {BLOCK_ROWS} * block) AS size FROM placed JOIN z USING (k)),
begun AS (SELECT k, slot, block, sum(size) OVER (ORDER BY slot) - size AS start FROM sized)
SELECT doc_id, source, block, slot, CAST(start + row % {BLOCK_ROWS} AS BIGINT) AS position FROM r JOIN begun ON begun.k = r.k AND begun.block = r.row // {BLOCK_ROWS}
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


_SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
firsts AS (SELECT h, min(struct_pack(d := doc_id, i := i)) AS f FROM win WHERE doc_id IS NOT NULL GROUP BY h),
hit AS (SELECT r, i FROM win JOIN firsts USING (h) WHERE struct_pack(d := doc_id, i := i) > f),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM hit) GROUP BY r),
kept AS (SELECT r, list(x ORDER BY p) AS k FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) LEFT JOIN gone USING (r) WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (SELECT text, min(doc_id) AS rep_id FROM d WHERE len(w) > 0 GROUP BY text)
SELECT doc_id, coalesce(rep_id, doc_id) AS rep_id, class_id, coalesce(n, 0) AS n_links FROM d JOIN k ON k.a = doc_id LEFT JOIN l ON l.a = doc_id LEFT JOIN r ON r.text = d.text
"""

_SQUARED = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

#: Four rounds of assigning and averaging, and the last assignment.
_CODES_SQL = (
    """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT r, part, list_slice(x, (part - 1) * len(x) // 4 + 1, part * len(x) // 4) AS x FROM v, (SELECT unnest([1, 2, 3, 4]) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= 256),"""
    + "".join(
        f"""
a{i} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := {_SQUARED}, e := b.e)) AS f FROM p JOIN b{i} b USING (part) GROUP BY p.r, p.part),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT part, e, list(y ORDER BY i) AS x FROM (SELECT part, f.e AS e, i, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS y FROM (SELECT p.part, f, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{i} USING (r, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, e)),"""
        for i in range(4)
    )
    + f"""
a4 AS (SELECT p.r, p.part, min(struct_pack(d := {_SQUARED}, e := b.e)) AS f FROM p JOIN b4 b USING (part) GROUP BY p.r, p.part),
c AS (SELECT r, string_agg(lpad(lower(to_hex(f.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(f.d) AS BIGINT) AS error FROM a4 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h
"""
)

_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(t) * docs) // total)))) AS part FROM p JOIN d USING (r) JOIN w USING (term), s),
f AS (SELECT item_id, doc_id, r, CAST(sum(part) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _MIXING_SQL, "op2_substring_dedup": _SUBSTRING_SQL, "op4_embedding_dedup": _EMBEDDING_SQL, "op5_topk_search": _TOPK_SQL, "op6_url_filters": _URL_SQL, "op10_ngram_join": _JOIN_SQL, "op12_vector_codes": _CODES_SQL, "op13_ranked_search": _RANKED_SQL}
