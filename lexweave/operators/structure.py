"""From block rows to citable units: headings, hierarchy, numbering spaces and paragraphs, by windows over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, strip_accents

# Paragraph classes that are no body, and the mark of a repealed text.
NOT_BODY = ("articulo", "anexo", "titulo_num", "titulo_tit", "capitulo_num", "capitulo_tit", "firma")
REPEALED = r"(?i)\(derogad[oa]"
NUMBERED = r"\A(\d+)\.(?U:\s)"
#: Numbering space before the body has begun.
DECREE = "rd"


def heading_rank(plain: Column) -> Column:
    """titulo, capitulo or seccion for a heading without accents in lower case, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rank in ("titulo", "capitulo", "seccion"):
        out = out.when((plain == rank) | plain.startswith(rank + " "), rank)
    return out


def designator(plain: Column) -> Column:
    """struct(designator, tipo) of an article, a disposition or an annex, else null fields."""
    tight = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    article, other, annex = r"(?U)\Aarticulo\s+(.+)\z", r"(?U)\Adisposicion\s+(adicional|derogatoria|final|transitoria)\s+(.+)\z", r"(?U)\Aanexo\s+(.+)\z"
    name = F.when(plain.rlike(article), tight(F.regexp_extract(plain, article, 1))).when(plain.rlike(other), F.concat(F.lit("d"), F.substring(F.regexp_extract(plain, other, 1), 1, 1), tight(F.regexp_extract(plain, other, 2)))).when(plain.rlike(annex), F.concat(F.lit("anexo"), tight(F.regexp_extract(plain, annex, 1))))
    kind = F.when(plain.rlike(article), "articulo").when(plain.rlike(other), "disposicion").when(plain.rlike(annex), "anexo")
    return F.struct(name.alias("designator"), kind.alias("tipo"))


def rubric(heading: Column, title: Column) -> Column:
    prefix = F.concat(title, F.lit("."))
    return F.when(heading.startswith(prefix), strip(heading.substr(F.length(prefix) + 1, F.length(heading)))).otherwise(strip(heading))


def hierarchy(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", rank: str = "rank", label: str = "label", reset: str | None = None) -> DataFrame:
    """Adds titulo, capitulo and seccion: the last heading of each rank before a row.

    A heading of higher rank clears the lower ones; a row where ``reset`` is true
    clears all for those after it. A document is one window partition.
    """
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.col(reset) if reset else F.lit(False)

    def level(own: str, above: list[str]) -> Column:
        event = F.when(cleared, F.struct(F.lit(None).cast("string").alias("v"))).when(F.col(rank) == own, F.struct(F.col(label).alias("v")))
        if above:
            event = event.when(F.col(rank).isin(*above), F.struct(F.lit(None).cast("string").alias("v")))
        return F.last(event, ignorenulls=True).over(before)["v"]

    return rows.withColumns({"titulo": level("titulo", []), "capitulo": level("capitulo", ["titulo"]), "seccion": level("seccion", ["titulo", "capitulo"])})


def numbering_space(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", title: str = "is_title", annex: str = "annex", opening: str = "opens") -> DataFrame:
    """Adds contenedor: the numbering space that each row stands in.

    It is ``rd`` at first; a title leads into the body (''), an annex heading into
    the annex named in ``annex``, and the first other heading (``opens``) into the
    body while it is still ``rd``.
    """
    own = Window.partitionBy(doc).orderBy(pos)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(F.col(title), F.lit("")).when(F.col(annex).isNotNull(), F.col(annex))
    any_before = F.count(F.when(F.col(title) | F.col(annex).isNotNull() | F.col(opening), 1)).over(before)
    event = F.coalesce(sure, F.when(F.col(opening) & (any_before == 0), F.lit("")))
    return rows.withColumn("_event", event).withColumn("contenedor", F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(DECREE))).drop("_event")


def split_paragraphs(rows: DataFrame, keys: list[str], pos: str = "pos", text: str = "text", number: Column | None = None, body: Column | None = None) -> DataFrame:
    """``keys``, apartados: paragraphs that open with a number start an item, others join the item before with a line break."""
    given = F.regexp_extract(text, NUMBERED, 1)
    number = F.when(given != "", given) if number is None else number
    body = F.regexp_replace(F.col(text), NUMBERED, "") if body is None else body
    order = Window.partitionBy(*keys).orderBy(pos)
    opened = rows.withColumn("_n", number).withColumn("_island", F.sum(F.when(F.col("_n").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), body.alias("t")))), lambda s: s["t"]), "\n")
    items = opened.groupBy(*keys, "_island").agg(F.max("_n").alias("numero"), part.alias("texto"))
    every = F.array_sort(F.collect_list(F.struct("_island", "numero", "texto")))
    return items.groupBy(*keys).agg(F.transform(every, lambda s: F.struct(s["numero"].alias("numero"), s["texto"].alias("texto"))).alias("apartados"))


def split_array(texts: Column) -> Column:
    """The same over an array of paragraphs, inside a row."""
    none = F.expr("cast(array() as array<struct<numero:string,texto:string>>)")

    def step(done: Column, p: Column) -> Column:
        number = F.regexp_extract(p, NUMBERED, 1)
        opened = F.struct(F.when(number != "", number).alias("numero"), F.regexp_replace(p, NUMBERED, "").alias("texto"))
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["numero"].alias("numero"), F.concat(last["texto"], F.lit("\n"), p).alias("texto"))
        return F.when((number != "") | (F.size(done) == 0), F.concat(done, F.array(opened))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(texts, none, step)


def units(blocks: DataFrame, norm: Column) -> DataFrame:
    """Citable units of block rows, in reading order; ``norm`` names each document's norm.

    Blocks without a designator, a version or body text are none. References that
    occur twice within a document get their title's mark, on all that have a title.
    """
    rows = blocks.where("error is null").withColumns({"norma": norm, "plain": strip_accents(F.col("titulo"))}).withColumnRenamed("titulo", "rotulo").withColumnRenamed("tipo", "block_tipo")
    rows = rows.withColumns({"rank": heading_rank(F.col("plain")), "d": designator(F.col("plain"))})
    heads = (F.col("block_tipo") == "encabezado") & F.col("rank").isNull()
    rows = rows.withColumns({"is_title": F.coalesce(F.col("rank") == "titulo", F.lit(False)), "annex": F.when(heads & (F.col("d.tipo") == "anexo"), F.col("d.designator")), "opens": heads & F.coalesce(F.col("d.tipo") != "anexo", F.lit(True))})
    rows = numbering_space(rows)
    rows = rows.withColumn("turns", F.coalesce(F.col("annex") != F.col("contenedor"), F.lit(False)))
    rows = hierarchy(rows, rank="rank", label="rotulo", reset="turns")

    titled = F.transform(F.filter("paras", lambda p: p["class"].isin("articulo", "anexo")), lambda p: rubric(p["text"], F.col("rotulo")))
    body = F.transform(F.filter("paras", lambda p: ~p["class"].isin(*NOT_BODY) & (p["text"] != "")), lambda p: p["text"])
    rows = rows.where(F.col("rank").isNull() & F.col("d.tipo").isNotNull() & F.col("version").isNotNull()).withColumn("body", body).where("size(body) > 0")
    article = F.when((F.col("d.tipo") == "anexo") | (F.col("contenedor") == ""), F.col("d.designator")).otherwise(F.concat_ws("-", "contenedor", "d.designator"))
    out = rows.select(
        "doc_id", "pos", "norma", article.alias("articulo"), F.col("d.tipo").alias("tipo"), "rotulo", F.coalesce(F.get(F.filter(titled, lambda t: t != ""), F.lit(0)), F.lit("")).alias("rubrica"), split_array(F.col("body")).alias("apartados"),
        "titulo", "capitulo", "seccion", (~F.exists("body", lambda t: t.rlike(REPEALED))).alias("vigente"), F.col("version.id_norma").alias("id_norma_version"), F.col("version.fecha_vigencia").alias("fecha_vigencia"),
    )
    mark = F.regexp_replace(F.regexp_replace(strip_accents(F.col("titulo")), r"\Atitulo", ""), "[^a-z0-9]", "")
    times = F.count("*").over(Window.partitionBy("doc_id", "norma", "articulo"))
    own = out.withColumn("_mark", mark).withColumn("_times", times)
    return own.withColumn("articulo", F.when((F.col("_times") > 1) & F.col("titulo").isNotNull(), F.concat(F.lit("t"), "_mark", F.lit("-"), "articulo")).otherwise(F.col("articulo"))).drop("_mark", "_times")
