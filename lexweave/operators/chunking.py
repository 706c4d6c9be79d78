"""Chunkers: units to content-addressed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, content_hash, doc_id
from ..functions.refs import format_ref

# The chunkers' names, which are part of an index's identity.
ARTICLE, PARAGRAPH, MULTILEVEL = "articulo-v1", "apartado-v1", "multinivel-v1"


def _line(a: Column) -> Column:
    return F.when(a["numero"].isNotNull(), F.concat(a["numero"], F.lit(". "), a["texto"])).otherwise(a["texto"])


def _head() -> Column:
    return F.concat("rotulo", F.lit(". "), "rubrica", F.lit("\n"))


def whole_content() -> Column:
    return F.concat(_head(), F.array_join(F.transform("apartados", _line), "\n"))


def _checked(units: DataFrame, source_uri: Column) -> DataFrame:
    """Units in force, with the document's id; an empty source or a unit without text fails the query."""
    uri = F.when(F.coalesce(F.trim(source_uri), F.lit("")) == "", F.raise_error(F.lit("empty source_uri")).cast("string")).otherwise(source_uri)
    text = F.when(F.coalesce(F.size("apartados"), F.lit(0)) <= 0, F.raise_error(F.concat(F.lit("no text: "), F.col("articulo"))).cast("boolean")).otherwise(F.lit(True))
    return units.withColumn("doc_id", doc_id(uri)).where("vigente").where(text)


def _numbered(pieces: DataFrame, chunker: str, order: list[str]) -> DataFrame:
    """Adds hash, occurrence, ordinal and id; a document is one window partition."""
    by = Window.partitionBy("doc_id").orderBy(*order)
    rows = pieces.withColumn("content_hash", content_hash(F.col("content")))
    rows = rows.withColumns({"ordinal": F.row_number().over(by) - 1, "occurrence": F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy(*order)) - 1})
    rows = rows.withColumns({"chunk_id": chunk_id(F.col("doc_id"), F.col("content_hash"), F.col("occurrence")), "ref": format_ref(F.col("norma"), F.col("articulo"), F.col("apartado")), "chunker_id": F.lit(chunker)})
    return rows.select("chunk_id", "doc_id", "ordinal", "occurrence", "content", "content_hash", "ref", "norma", "articulo", "apartado", "chunker_id", "titulo", "capitulo", "seccion", "id_norma_version", "fecha_vigencia")


def chunk_article(units: DataFrame, source_uri: Column) -> DataFrame:
    """One chunk for each unit in force."""
    rows = _checked(units, source_uri).withColumns({"content": whole_content(), "apartado": F.lit(None).cast("string")})
    return _numbered(rows, ARTICLE, ["pos"])


def chunk_paragraph(units: DataFrame, source_uri: Column) -> DataFrame:
    """One chunk for each numbered item where all items are numbered, else the whole unit."""
    single = F.array(F.struct(F.lit(None).cast("string").alias("apartado"), whole_content().alias("content")))
    items = F.transform("apartados", lambda a: F.struct(a["numero"].alias("apartado"), F.concat(_head(), _line(a)).alias("content")))
    pieces = F.when(F.forall("apartados", lambda a: a["numero"].isNotNull()), items).otherwise(single)
    rows = _checked(units, source_uri).select("*", F.posexplode(pieces).alias("item", "piece")).withColumns({"apartado": F.col("piece.apartado"), "content": F.col("piece.content")})
    return _numbered(rows, PARAGRAPH, ["pos", "item"])


def chunk_multilevel(units: DataFrame, source_uri: Column) -> DataFrame:
    """Whole units that fall into several items first, then all items; numbered through. Equal ids fail the query."""
    items = chunk_paragraph(units, source_uri)
    split = items.groupBy("doc_id", "norma", "articulo").agg(F.count("*").alias("n")).where("n > 1")
    whole = chunk_article(units, source_uri).join(split, ["doc_id", "norma", "articulo"], "left_semi")
    both = whole.withColumn("_level", F.lit(0)).unionByName(items.withColumn("_level", F.lit(1)))
    by = Window.partitionBy("doc_id").orderBy("_level", "ordinal")
    once = F.count("*").over(Window.partitionBy("doc_id", "chunk_id"))
    rows = both.withColumns({"ordinal": F.row_number().over(by) - 1, "chunker_id": F.lit(MULTILEVEL), "_times": once})
    unique = F.when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("two chunks with the id "), F.col("chunk_id"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(unique).drop("_level", "_times")


CHUNKERS = {ARTICLE: chunk_article, PARAGRAPH: chunk_paragraph, MULTILEVEL: chunk_multilevel}


def chunker(name: str):
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; there are {', '.join(CHUNKERS)}")
    return CHUNKERS[name]
