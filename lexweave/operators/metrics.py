"""Set-based retrieval and answer metrics.

A metric is one row (id, valor, n): null with n = 0 where no case counts.
``cases``: id, refs (array, duplicates count), and ``predictions``: caso_id, refs, abstenida.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import ARTICLE, cites, refs_match


def _metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(F.avg(value.cast("double")).alias("valor"), F.count(value).alias("n")).select(F.lit(name).alias("id"), "valor", "n")


def pair(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each case with its one prediction; missing, unknown and repeated ones fail the query."""
    counted = predictions.groupBy("caso_id").agg(F.count("*").alias("times"), F.first("refs").alias("cited"), F.first("abstenida").alias("abstenida"))
    both = cases.select("id", "refs").join(counted, F.col("id") == F.col("caso_id"), "full_outer")
    problem = F.when(F.col("id").isNull(), F.concat(F.lit("unknown case "), F.col("caso_id").cast("string"))).when(F.col("caso_id").isNull(), F.concat(F.lit("no prediction for "), F.col("id").cast("string"))).when(F.col("times") > 1, F.concat(F.lit("repeated prediction for "), F.col("id").cast("string")))
    return both.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))).select("id", "refs", "cited", "abstenida")


def pair_problems(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, problem) for all that ``pair`` would fail on."""
    counted = predictions.groupBy("caso_id").agg(F.count("*").alias("times"))
    both = cases.select("id").join(counted, F.col("id") == F.col("caso_id"), "full_outer")
    kind = F.when(F.col("id").isNull(), "unknown").when(F.col("caso_id").isNull(), "missing").when(F.col("times") > 1, "repeated")
    return both.select(F.coalesce("id", "caso_id").alias("id"), kind.alias("problem")).where("problem is not null")


def recall_at_k(cases: DataFrame, retrieved: DataFrame, k: int, match=cites) -> DataFrame:
    """The mean share of each case's references found in its first ``k`` rows (caso_id, rank, legal_ref), each at its own level."""
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = cases.select("id", F.posexplode("refs").alias("pos", "want"))
    rows = retrieved.where(F.col("rank") <= k).select(F.col("caso_id").alias("id"), "legal_ref")
    found = wanted.join(rows, "id", "left").groupBy("id", "pos").agg(F.max(F.coalesce(match(F.col("legal_ref"), F.col("want")), F.lit(False))).alias("hit"))
    each = found.groupBy("id").agg(F.avg(F.col("hit").cast("double")).alias("recall"))
    return _metric(each, f"recall@{k}", F.col("recall"))


def citation_precision(pairs: DataFrame, article_level: bool = False) -> DataFrame:
    """The share of answered cases whose citations all belong; none cited is a miss."""
    same = (lambda c, r: refs_match(c, r, ARTICLE)) if article_level else cites
    right = (F.size("cited") > 0) & F.forall("cited", lambda c: F.exists("refs", lambda r: same(c, r)))
    return _metric(pairs, "precision_cita_articulo" if article_level else "precision_cita", F.when(~F.col("abstenida"), right))


def unknown_refs(cited: DataFrame, known_refs: DataFrame) -> DataFrame:
    """The rows of ``cited`` whose reference (column ref) the index lacks."""
    return cited.join(known_refs.select("ref").distinct(), "ref", "left_anti")


def hallucination(pairs: DataFrame, known_refs: DataFrame) -> DataFrame:
    """The share of answered cases that cite a reference which the index (column ref) lacks."""
    cited = pairs.where(~F.col("abstenida")).select("id", F.explode("cited").alias("ref"))
    bad = unknown_refs(cited, known_refs).select("id").distinct().withColumn("bad", F.lit(True))
    flags = pairs.join(bad, "id", "left")
    return _metric(flags, "alucinacion", F.when(~F.col("abstenida"), F.coalesce("bad", F.lit(False))))


def coverage(pairs: DataFrame) -> DataFrame:
    return _metric(pairs, "cobertura", F.when(F.size("refs") > 0, ~F.col("abstenida")))


def abstain_fp(pairs: DataFrame) -> DataFrame:
    return _metric(pairs, "abstencion_incorrecta", F.when(F.size("refs") > 0, F.col("abstenida")))


def abstain_fn(pairs: DataFrame) -> DataFrame:
    return _metric(pairs, "abstencion_indebida", F.when(F.size("refs") == 0, ~F.col("abstenida")))


def citation_f1(pairs: DataFrame) -> DataFrame:
    """An extension: the harmonic mean of citation precision and coverage of the references, averaged over answered cases."""
    hit = F.size(F.filter("cited", lambda c: F.exists("refs", lambda r: cites(c, r))))
    got = F.size(F.filter("refs", lambda r: F.exists("cited", lambda c: cites(c, r))))
    p, r = hit / F.size("cited"), got / F.size("refs")
    f1 = F.when((F.size("cited") > 0) & (F.size("refs") > 0) & (p + r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return _metric(pairs, "citation_f1", F.when(~F.col("abstenida"), f1))


def quote_literal(citations: DataFrame, literal: Column) -> DataFrame:
    """Literal citations among all; 1 where there are none."""
    return citations.agg(F.coalesce(F.avg(literal.cast("double")), F.lit(1.0)).alias("valor"), F.count("*").alias("n")).select(F.lit("cita_literal").alias("id"), "valor", "n")


def abstain_by_reason(results: DataFrame, motivo: str = "motivo") -> DataFrame:
    return results.groupBy(F.coalesce(motivo, F.lit("sin_motivo_declarado")).alias("motivo")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "motivo")


def strata(cases: DataFrame, subject: str = "materia", difficulty: str = "dificultad", kind: str = "tipo") -> DataFrame:
    """(stratum, value, n): counts by subject, by difficulty, by kind and of all, in one pass of grouping sets."""
    rows = cases.groupingSets([[F.col(subject)], [F.col(difficulty)], [F.col(kind)], []], F.col(subject), F.col(difficulty), F.col(kind)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "materia").when(F.col("g") == 5, "dificultad").when(F.col("g") == 6, "tipo").otherwise("todo")
    value = F.when(F.col("g") == 3, F.col(subject)).when(F.col("g") == 5, F.col(difficulty)).when(F.col("g") == 6, F.col(kind))
    return rows.select(name.alias("stratum"), value.cast("string").alias("value"), "n")


# The least sizes of a sound set of cases.
FLOOR = {"positivos": 150, "negativos": 40, "fraccion_negativos": 0.15, "materias": 6, "casos_por_materia": 20}


def statistical_floor(cases: DataFrame, floor: dict = FLOOR, subject: str = "materia", kind: str = "tipo") -> DataFrame:
    """(rule, value, least, ok), also for no cases."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("double")
    total = cases.agg(count(F.col(kind) == "positivo").alias("p"), count(F.col(kind) == "negativo").alias("m"), F.count("*").alias("all"))
    big = cases.groupBy(subject).agg(F.count("*").alias("n")).agg(count(F.col("n") >= floor["casos_por_materia"]).alias("s"))
    share = F.when(F.col("all") > 0, F.col("m") / F.col("all")).otherwise(0.0)
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), v.alias("value"), F.lit(float(floor[name])).alias("least")) for name, v in (("positivos", F.col("p")), ("negativos", F.col("m")), ("fraccion_negativos", share), ("materias", F.col("s")))])
    return total.join(F.broadcast(big)).select(F.inline(rules)).withColumn("ok", F.col("value") >= F.col("least"))  # both sides are one row


def gate(results: DataFrame, order: str = "id") -> DataFrame:
    """Goal results up to the first that is not passed, that one included: a goal that was not measured is not passed."""
    first = results.where(~F.col("passed")).agg(F.min(order).alias("_red"))
    return results.crossJoin(F.broadcast(first)).where(F.col("_red").isNull() | (F.col(order) <= F.col("_red"))).drop("_red")  # first is one row


def fallen(now: DataFrame, before: DataFrame, key: str = "file", count: str = "n") -> DataFrame:
    """(``key``, was, is): counts that are lower than in the snapshot, 0 for what has gone."""
    both = before.select(key, F.col(count).alias("was")).join(now.select(key, F.col(count).alias("is")), key, "left")
    return both.withColumn("is", F.coalesce("is", F.lit(0).cast(now.schema[count].dataType))).where("is < was")


def goal_results(goals: DataFrame, measured: DataFrame) -> DataFrame:
    """Each goal (id, operator, target) with its measured value: passed is false where nothing was measured."""
    v, t, o = F.col("valor"), F.col("target"), F.col("operator")
    passed = F.when(o == "==", v == t).when(o == ">=", v >= t).when(o == "<=", v <= t)
    return goals.join(measured.select("id", "valor"), "id", "left").withColumn("passed", F.coalesce(passed, F.lit(False)))
