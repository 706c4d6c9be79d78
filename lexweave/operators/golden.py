"""Review verdicts, building the set of cases, and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import article_of, parse_ref
from .metrics import statistical_floor
from .sampling import difficulty

# Verdicts that take a case out, and the pace at which a reviewer is warned.
OUT = ("descartar", "saltar")
SLOW_SECONDS, PACE_SAMPLES = 180, 20


def last_verdict(verdicts: DataFrame, id_col: str = "id", order: str = "line_no") -> DataFrame:
    """The verdict with the highest line number of each id."""
    row = F.struct(F.col(order), *[F.col(c) for c in verdicts.columns if c != order])
    return verdicts.groupBy(id_col).agg(F.max_by(row, F.col(order)).alias("_v")).select("_v.*")


def pending(queue: DataFrame, verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    return queue.join(verdicts.select(id_col).distinct(), id_col, "left_anti")


def blind_view(rows: DataFrame) -> DataFrame:
    """What a reviewer sees: for blind cases neither proposed reference nor note nor text; a negative shows what answers it."""
    shown = lambda c: F.when(~F.col("a_ciegas"), F.col(c))
    ref = F.when(F.col("tipo") == "negativo", F.col("responde")).otherwise(F.col("ref"))
    return rows.select("id", "pregunta", "a_ciegas", F.when(~F.col("a_ciegas"), ref).alias("ref"), shown("nota").alias("nota"), shown("texto").alias("texto"))


def blind_verdict(typed: Column, proposed: Column) -> Column:
    return F.struct(typed.alias("ref"), proposed.alias("ref_agente"), F.coalesce(typed == proposed, F.lit(False)).alias("coincide"))


def key_valid(key: Column, blind: Column, kind: Column) -> Column:
    """Accepting the proposal ('a') means nothing where it is hidden."""
    return ~((key == "a") & blind & (kind == "positivo"))


def build(queue: DataFrame, proposals: DataFrame, verdicts: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Cases: (id, pregunta, refs, materia, dificultad, tipo) of all with a last verdict that keeps them.

    A verdict's reference goes before the proposed one; a negative that the
    proposal can answer becomes positive with that reference.
    """
    last = last_verdict(verdicts).select("id", "veredicto", F.col("ref").alias("v_ref"))
    offer = proposals.select("id", F.col("ref").alias("p_ref"), "responde")
    rows = queue.join(last, "id").join(offer, "id", "left").where(~F.col("veredicto").isin(*OUT))
    if excluded:
        rows = rows.where(~F.col("id").isin(*excluded))
    turned = (F.col("tipo") == "negativo") & F.col("responde").isNotNull()
    ref = F.coalesce("v_ref", F.when(turned, F.col("responde")), F.when(F.col("tipo") == "positivo", F.col("p_ref")))
    kind = F.when((F.col("tipo") == "positivo") | turned, "positivo").otherwise("negativo")
    refs = F.when((kind == "positivo") & ref.isNotNull(), F.array(ref)).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select("id", "pregunta", refs.alias("refs"), F.col("tema").alias("materia"), difficulty(F.col("pct_fallo")).alias("dificultad"), kind.alias("tipo"))


def review_summary(verdicts: DataFrame, left: int | None = None) -> DataFrame:
    """n, agreement, blind_agreement, discards, median_seconds and hours_left; null where nothing counts."""
    share = lambda ok, of: F.avg(F.when(of, ok.cast("double")))
    judged = ~F.col("veredicto").isin("saltar")
    out = verdicts.agg(
        F.count("*").alias("n"),
        share(F.col("veredicto") == "ok", judged & ~F.col("a_ciegas")).alias("agreement"),
        share(F.col("coincide"), F.col("a_ciegas")).alias("blind_agreement"),
        F.count(F.when(F.col("veredicto") == "descartar", 1)).alias("discards"),
        F.percentile("segundos", 0.5).alias("median_seconds"),
    )
    return out.withColumn("hours_left", F.col("median_seconds") * F.lit(left) / 3600)


def pace_alert(verdicts: DataFrame) -> DataFrame:
    """n, median_seconds, alert: slow after enough verdicts."""
    out = verdicts.agg(F.count("segundos").alias("n"), F.percentile("segundos", 0.5).alias("median_seconds"))
    return out.withColumn("alert", F.coalesce((F.col("n") >= PACE_SAMPLES) & (F.col("median_seconds") > SLOW_SECONDS), F.lit(False)))


def incoherent(cases: DataFrame) -> DataFrame:
    """(id, problem) by the rules of one case."""
    rules = {
        "negative with references": (F.col("tipo") == "negativo") & (F.size("refs") > 0),
        "positive without references": (F.col("tipo") == "positivo") & (F.size("refs") == 0),
        "positive without an answer": (F.col("tipo") == "positivo") & (F.coalesce(F.trim("respuesta_referencia"), F.lit("")) == ""),
        "no reviewer": F.coalesce(F.trim("revisado_por"), F.lit("")) == "",
        "no review date": F.col("revisado_en").isNull(),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return cases.select("id", F.explode(found).alias("problem"))


def duplicate_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def missing_refs(cases: DataFrame, known: DataFrame) -> DataFrame:
    """(id, ref) for references that no known one (column ref) matches at the level of articles."""
    wanted = cases.select("id", F.explode("refs").alias("ref")).withColumn("article", article_of(F.col("ref")))
    return wanted.join(known.select(article_of(F.col("ref")).alias("article")).distinct(), "article", "left_anti").select("id", "ref")


def validate(cases: DataFrame, known: DataFrame, near: DataFrame | None = None, corrupt: DataFrame | None = None) -> DataFrame:
    """(rule, id, detail): all violations at once; ``near`` holds pairs a, b, ``corrupt`` lines that could not be read."""
    as_rows = lambda df, rule, i, d: df.select(F.lit(rule).alias("rule"), i.cast("string").alias("id"), d.cast("string").alias("detail"))
    out = as_rows(incoherent(cases), "coherence", F.col("id"), F.col("problem"))
    out = out.unionByName(as_rows(duplicate_ids(cases), "unique ids", F.col("id"), F.col("n")))
    out = out.unionByName(as_rows(missing_refs(cases, known), "references exist", F.col("id"), F.col("ref")))
    unread = cases.select("id", F.explode("refs").alias("ref")).withColumn("p", parse_ref(F.col("ref"), ascii_only=True)).where("p.error is not null")
    out = out.unionByName(as_rows(unread, "references parse", F.col("id"), F.col("p.error")))
    out = out.unionByName(as_rows(statistical_floor(cases).where("not ok"), "statistical floor", F.col("rule"), F.col("value")))
    if near is not None:
        out = out.unionByName(as_rows(near, "near duplicates", F.col("a"), F.col("b")))
    if corrupt is not None:
        out = out.unionByName(as_rows(corrupt, "schema", F.lit(None), F.col("_bad")))
    return out


def text_of_ref(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, texto): the paragraph's text where the unit has it, else the whole article's."""
    parsed = refs.select("ref", parse_ref(F.col("ref"), ascii_only=True).alias("p"))
    own = units.select("norma", "articulo", "apartados")
    rows = parsed.join(own, (F.col("p.norma") == own.norma) & (F.col("p.articulo") == own.articulo), "left")
    exact = F.filter("apartados", lambda a: a["numero"] == F.col("p.apartado"))
    whole = F.array_join(F.transform("apartados", lambda a: F.when(a["numero"].isNotNull(), F.concat(a["numero"], F.lit(". "), a["texto"])).otherwise(a["texto"])), "\n")
    return rows.select("ref", F.when(F.size(exact) > 0, F.get(exact, F.lit(0))["texto"]).otherwise(whole).alias("texto"))
