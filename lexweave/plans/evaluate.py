"""Evaluation of retrieval and of answers, as one plan for all cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.refs import article_of, cites
from ..operators import metrics as M


def eval_retrieval(cases: DataFrame, channels: dict[str, DataFrame], ks: tuple[int, ...] = (5, 30)) -> DataFrame:
    """(channel, reading, id, valor, n): recall at each k, strict and by article, of each channel's ranking.

    By article both sides are cut to articles; references that become equal still
    count apart. Each wanted reference's first place in each ranking decides all k
    at once, so a ranking is read once.
    """
    readings = lambda ref: F.explode(F.array(F.struct(F.lit("strict").alias("reading"), ref.alias("ref")), F.struct(F.lit("article").alias("reading"), article_of(ref).alias("ref"))))
    names = F.array(*map(F.lit, channels))
    every = None
    for name, ranking in channels.items():
        one = ranking.where(F.col("rank") <= max(ks)).select(F.lit(name).alias("channel"), F.col("caso_id").alias("id"), "rank", "legal_ref")
        every = one if every is None else every.unionByName(one)
    hits = every.select("channel", "id", "rank", readings(F.col("legal_ref")).alias("h")).select("channel", "id", "rank", "h.reading", F.col("h.ref").alias("legal_ref"))
    wanted = cases.select("id", F.posexplode("refs").alias("pos", "want")).select("id", "pos", F.explode(names).alias("channel"), readings(F.col("want")).alias("w")).select("id", "pos", "channel", "w.reading", F.col("w.ref").alias("want"))
    place = F.min(F.when(cites(F.col("legal_ref"), F.col("want")), F.col("rank")))
    first = wanted.join(hits, ["channel", "reading", "id"], "left").groupBy("channel", "reading", "id", "pos").agg(place.alias("place"))
    each = first.groupBy("channel", "reading", "id").agg(*[F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")).alias(f"k{k}") for k in ks])
    means = each.groupBy("channel", "reading").agg(F.count("*").alias("n"), *[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    grid = cases.sparkSession.range(1).select(F.explode(names).alias("channel")).withColumn("reading", F.explode(F.array(F.lit("strict"), F.lit("article"))))
    rows = F.explode(F.array(*[F.struct(F.lit(f"recall@{k}").alias("id"), F.col(f"k{k}").alias("valor")) for k in ks]))
    return grid.join(means, ["channel", "reading"], "left").select("channel", "reading", rows.alias("r"), F.coalesce("n", F.lit(0)).alias("n")).select("channel", "reading", "r.id", "r.valor", "n")


def eval_answers(cases: DataFrame, predictions: DataFrame, known_refs: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """The answer metrics (id, valor, n); ``citations`` (literal) adds the share of literal quotations."""
    pairs = M.pair(cases, predictions)
    parts = [M.citation_precision(pairs), M.citation_precision(pairs, True), M.hallucination(pairs, known_refs), M.coverage(pairs), M.abstain_fp(pairs), M.abstain_fn(pairs)]
    if citations is not None:
        parts.append(M.quote_literal(citations, F.col("literal")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eval_agent(cases: DataFrame, predictions: DataFrame, known_refs: DataFrame, results: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """The answer metrics, and the abstentions by reason as rows ``motivo:<reason>`` with their share and number.

    ``results`` has motivo for each abstained request.
    """
    reasons = M.abstain_by_reason(results)
    total = results.agg(F.count("*").alias("all"))
    shares = reasons.crossJoin(F.broadcast(total)).select(F.concat(F.lit("motivo:"), "motivo").alias("id"), (F.col("n") / F.col("all")).alias("valor"), "n")  # total is one row
    return eval_answers(cases, predictions, known_refs, citations).unionByName(shares)


def smoke(hits: DataFrame, known_refs: DataFrame) -> DataFrame:
    """(query_id, unknown, found) of each question's hits: references that the index lacks, and whether any is known."""
    flagged = hits.join(known_refs.select(F.col("ref").alias("legal_ref"), F.lit(True).alias("known")).distinct(), "legal_ref", "left")
    return flagged.groupBy("query_id").agg(F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("found"))


def report(metrics: DataFrame, **head: str) -> DataFrame:
    """One JSON document with its keys sorted."""
    body = F.array_sort(F.collect_list(F.struct("id", "n", "valor")))
    fields = {**{k: F.lit(v) for k, v in head.items()}, "metrics": body}
    return metrics.agg(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).alias("report"))
