"""Answering questions from an index: retrieval alone, or drafting, verification and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import citations as C
from ..functions.text import query_terms, spanish_lexemes
from ..operators import search, verification
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from .index import Index

# What a question and a number of results may be.
QUESTION_LENGTH, RESULTS = (3, 500), (1, 20)


def with_terms(questions: DataFrame) -> DataFrame:
    """Questions that have a word to search for; others fail the query."""
    some = F.size(query_terms(F.col("pregunta"))) > 0
    return questions.where(F.when(some, F.lit(True)).otherwise(F.raise_error(F.lit("a question without a word")).cast("boolean")))


def checked(questions: DataFrame) -> DataFrame:
    """Questions of an allowed length; others fail the query."""
    n = F.length("pregunta")
    return questions.where(F.when(n.between(*QUESTION_LENGTH), F.lit(True)).otherwise(F.raise_error(F.lit("a question has 3 to 500 characters")).cast("boolean")))


def ask(questions: DataFrame, chunks: DataFrame, k: int = search.FINAL) -> DataFrame:
    """query_id, rank, legal_ref, content, titulo, distance of (query_id, pregunta, vector), by vectors alone."""
    if not RESULTS[0] <= k <= RESULTS[1]:
        raise ValueError("k lies between 1 and 20")
    docs = chunks.withColumnRenamed("ref", "legal_ref")
    hits = search.vector_topk(checked(questions), docs, k)
    return search.with_payload(written(hits), docs.select("legal_ref", "content", "titulo")).select("query_id", "rank", "legal_ref", "content", "titulo", "distance")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = search.FINAL, subject: str | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, per_channel: int = search.PER_CHANNEL, tokens: Callable[[Column], Column] = spanish_lexemes, words: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, rank, legal_ref, content, titulo by words and vectors. ``subject`` holds in the channel of words only.

    ``tokens`` are the words' forms that are compared, in questions and chunks. ``words`` and
    ``vectors`` are stored indexes of the chunks, by these forms; without them, and of words
    with a ``subject``, the chunks themselves are searched.
    """
    docs = chunks.withColumnRenamed("ref", "legal_ref")
    worded = docs.where(F.col("materia") == subject) if subject is not None else docs
    asked = with_terms(checked(questions))
    lexical = words.search(asked, per_channel, tokens=tokens) if words is not None and subject is None else search.lexical_topk(asked, worded, per_channel, tokens=tokens)
    vector = vectors.search(asked, per_channel, id_col="legal_ref") if vectors is not None else search.vector_topk(asked, docs, per_channel)
    found = search.hybrid_search(lexical, vector, k, rerank=rerank)
    return search.with_payload(written(found), docs.select("legal_ref", "content", "titulo")).select("query_id", "rank", "legal_ref", "content", "titulo")


def as_sources(found: DataFrame) -> DataFrame:
    """request_id, sources: each question's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("legal_ref").alias("ref"), F.col("content").alias("texto"))))
    return found.groupBy(F.col("query_id").alias("request_id")).agg(F.transform(rows, lambda r: F.struct(r["ref"].alias("ref"), r["texto"].alias("texto"))).alias("sources"))


def ask_cited(questions: DataFrame, found: DataFrame, generate: Callable[[DataFrame, int], DataFrame], template: str = "{pregunta}\n\n{fuentes}", relevance: DataFrame | None = None) -> DataFrame:
    """Cited answers: request_id, salida, reintentos, refs, motivo, answer, sources."""
    none = F.expr("cast(array() as array<struct<ref:string,texto:string>>)")
    requests = questions.select(F.col("query_id").alias("request_id"), "pregunta").join(as_sources(found), "request_id", "left").withColumn("sources", F.coalesce("sources", none))
    requests = requests.join(relevance, "request_id", "left") if relevance is not None else requests.withColumn("relevance", F.lit(None).cast("double"))
    requests = requests.withColumn("prompt", C.render_prompt(template, F.col("pregunta"), C.source_blocks(F.col("sources"))))
    return verification.answer_requests(requests, generate).join(requests.select("request_id", "sources"), "request_id")


def active_chunks(index: Index) -> DataFrame:
    return index.chunks()


def top_text(found: DataFrame) -> DataFrame:
    """The text of each question's first row, which the retrieval-only answer shows."""
    first = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "legal_ref", F.col("content").alias("answer"))
