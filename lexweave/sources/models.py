"""Ports to models: recorded ones are joins, live ones Arrow functions over an endpoint.

A port is a function from DataFrame to DataFrame. Recorded ports never invent: a
row without a recording fails the query.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cache_key, recording_key


def _required(column: str, what: str, name: Column) -> Column:
    missing = F.raise_error(F.concat(F.lit(f"no recorded {what} for "), F.coalesce(name.cast("string"), F.lit("null"))))
    return F.when(F.col(column).isNull(), missing.cast("string").isNotNull()).otherwise(F.lit(True))


def record_embeddings(texts: DataFrame, model: str, text_col: str = "content", vector_col: str = "embedding") -> DataFrame:
    """(key, vector): a recording that ``recorded_embedder`` reads."""
    return texts.select(recording_key(F.lit(model), F.col(text_col)).alias("key"), F.col(vector_col).alias("vector")).dropDuplicates(["key"])


def recorded_embedder(recording: DataFrame, model: str, text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    def embed(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("key", recording_key(F.lit(model), F.col(text_col)))
        return keyed.join(recording.select("key", F.col("vector").alias("embedding")), "key", "left").where(_required("embedding", "embedding", F.col(text_col))).drop("key")

    return embed


def recorded_generator(recording: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """``recording``: request_id, attempt, draft; one that is used up fails the query."""

    def generate(rows: DataFrame, attempt: int) -> DataFrame:
        mine = recording.where(F.col("attempt") == attempt).select("request_id", "draft")
        return rows.join(mine, "request_id", "left").where(_required("draft", "draft", F.col("request_id")))

    return generate


def recorded_reranker(recording: DataFrame, query_col: str = "query_id", id_col: str = "legal_ref") -> Callable[[DataFrame], DataFrame]:
    """``recording``: query, id, points."""
    from ..operators.search import rerank_scores

    return lambda ranked: rerank_scores(ranked.join(recording.select(query_col, id_col, "points"), [query_col, id_col], "left"))


def judgement_key(question: Column, refs: Column, model: str, prompt_version: int) -> Column:
    return cache_key(question, F.to_json(refs), F.lit(model), F.lit(prompt_version))


def through_cache(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with ``value``, the new cache rows): hits by join, misses computed once for each key."""
    missing = compute(rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])).select(key, value)
    return rows.join(cache.select(key, value).unionByName(missing), key, "left"), missing


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def http_embedder(base_url: str, model: str, dim: int, text_col: str = "content", batch: int = 32, timeout: float = 60, post: Callable = _post) -> Callable[[DataFrame], DataFrame]:
    """An endpoint with POST /v1/embeddings, in batches; the number and the width of its vectors are checked."""

    @F.arrow_udf("array<double>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows, out = column.to_pylist(), []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                data = sorted(post(f"{base_url}/v1/embeddings", {"model": model, "input": part}, timeout)["data"], key=lambda d: d["index"])
                if len(data) != len(part) or any(len(d["embedding"]) != dim for d in data):
                    raise ValueError(f"the endpoint gave {len(data)} vectors for {len(part)} texts, or other than {dim} wide")
                out += [d["embedding"] for d in data]
            yield pa.array(out, pa.list_(pa.float64()))

    return lambda rows: rows.withColumn("embedding", vectors(F.col(text_col)))


def http_generator(base_url: str, model: str, max_tokens: int = 512, temperature: float = 0.0, timeout: float = 120, post: Callable = _post) -> Callable[[DataFrame, int], DataFrame]:
    """An endpoint with POST /v1/chat/completions; an answer that is empty because it ran out of length fails."""

    @F.arrow_udf("string")
    def drafts(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in prompts:
            out = []
            for prompt in column.to_pylist():
                choice = post(f"{base_url}/v1/chat/completions", {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature}, timeout)["choices"][0]
                text = choice["message"]["content"] or ""
                if not text and choice.get("finish_reason") == "length":
                    raise ValueError("the answer ran out of length before it began")
                out.append(text)
            yield pa.array(out, pa.string())

    return lambda rows, attempt: rows.withColumn("draft", drafts(F.col("prompt")))


def _lines(url: str, body: dict, timeout: float) -> Iterator[str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        for line in answer:
            yield line.decode()


def _spoken(lines: Iterator[str]) -> Iterator[str]:
    """The text in each line of a streamed completion that carries some."""
    for line in map(str.strip, lines):
        if line.startswith("data:") and line[5:].strip() != "[DONE]":
            choices = json.loads(line[5:]).get("choices") or [{}]
            if text := (choices[0].get("delta") or {}).get("content"):
                yield text


def http_token_events(base_url: str, model: str, max_tokens: int = 256, temperature: float = 0.0, timeout: float = 120, lines: Callable = _lines, at_once: int = 16) -> Callable[[DataFrame], DataFrame]:
    """The same endpoint asked to stream: from rows with request_id, attempt, prompt, n_sources to what ``guard_stream`` takes.

    Rows may be a table or a stream. Tokens go on as their lines come, ``at_once`` in a
    batch. The guard reads along: with the token that retracts an attempt its request is
    closed and no further line is read. The last token has is_last; an answer without text is one empty token.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..streaming.guard import RETRACTED, Guard

        for b in batches:
            request_type = b.column(0).type
            for request, attempt, prompt, n_sources in zip(*(c.to_pylist() for c in b.columns)):
                body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature, "stream": True}
                guard, held, seq = Guard(n_sources or 0), [], 0

                def batch(last: bool, request=request, attempt=attempt, n_sources=n_sources) -> pa.RecordBatch:
                    n, first = len(held), seq - len(held)
                    columns = [pa.array([request] * n, request_type), pa.array([attempt] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string()), pa.array([n_sources] * n, pa.int32()), pa.array([last and i == n - 1 for i in range(n)])]
                    return pa.RecordBatch.from_arrays(columns, names=["request_id", "attempt", "seq", "token", "n_sources", "is_last"])

                answer = lines(f"{base_url}/v1/chat/completions", body, timeout)
                try:
                    for text in _spoken(answer):
                        if len(held) >= at_once:  # one more has come, so none of these is the last
                            yield batch(False)
                            held = []
                        held.append(text)
                        seq += 1
                        guard.take(text)
                        if guard.state == RETRACTED:
                            break
                finally:
                    if hasattr(answer, "close"):
                        answer.close()
                if not seq:
                    held, seq = [""], 1
                yield batch(True)

    def events(rows: DataFrame) -> DataFrame:
        kind = rows.schema["request_id"].dataType.simpleString()
        return rows.select("request_id", F.col("attempt").cast("int"), "prompt", F.col("n_sources").cast("int")).mapInArrow(tokens, f"request_id {kind}, attempt int, seq bigint, token string, n_sources int, is_last boolean")

    return events


def http_token_stream(base_url: str, model: str, **how) -> Callable[[DataFrame, int], DataFrame]:
    """The same for ``serve_requests``: from rows with request_id, prompt and sources to (request_id, seq, token)."""
    events = http_token_events(base_url, model, **how)

    def emit(rows: DataFrame, attempt: int) -> DataFrame:
        return events(rows.withColumns({"attempt": F.lit(attempt), "n_sources": F.size("sources")})).select("request_id", "seq", "token")

    return emit


def scored_by(load: Callable[[], Callable[[list[str], list[str]], list[float]]], question_col: str = "pregunta", text_col: str = "content", longest: int = 500) -> Callable[[DataFrame], DataFrame]:
    """A port for a cross-encoder: ``load`` gives, once a task and when its first rows come, what scores a batch's questions and texts (cut to ``longest``)."""

    @F.arrow_udf("double")
    def points(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        score = None
        for questions, texts in batches:
            if score is None:
                score = load()
            found = [float(x) for x in score(questions.to_pylist(), texts.to_pylist())]
            if len(found) != len(questions):
                raise ValueError(f"{len(found)} scores for {len(questions)} pairs")
            yield pa.array(found, pa.float64())

    return lambda rows: rows.withColumn("points", points(F.col(question_col), F.substring(text_col, 1, longest)))


def chat_delta(line: Column) -> Column:
    """The text in one line of a streamed completion; empty for lines that carry none."""
    parsed = F.from_json(F.trim(F.substring(line, 6, 1 << 30)), "choices array<struct<delta:struct<content:string>>>")
    return F.when(line.startswith("data:"), F.coalesce(F.get(parsed["choices"], F.lit(0))["delta"]["content"], F.lit(""))).otherwise("")


def max_relevance(scores: DataFrame, by: str = "request_id") -> DataFrame:
    return scores.groupBy(by).agg(F.max("points").alias("relevance"))
