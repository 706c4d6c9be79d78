"""Ingest: documents to a versioned index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import article_of
from ..operators.chunking import ARTICLE, chunker
from ..operators.structure import units
from .index import Index, index_id


def chunks_of(blocks: DataFrame, norm: Column, source_uri: Column, chunker_name: str = ARTICLE) -> DataFrame:
    return chunker(chunker_name)(units(blocks, norm), source_uri)


def ingest(index: Index, blocks: DataFrame, norm: Column, source_uri: Column, embed: Callable[[DataFrame], DataFrame], model: str, dim: int, chunker_name: str = ARTICLE, snapshot: str = "") -> DataFrame:
    """Chunks, embeds and upserts; returns the chunks written.

    ``embed`` adds embedding to rows with content. A chunk without a vector of the
    index's width fails the job.
    """
    spark, name = index.spark, index_id(model, dim, chunker_name)
    rows = embed(chunks_of(blocks, norm, source_uri, chunker_name)).withColumn("index_version", F.lit(name))
    right = F.when(F.coalesce(F.size("embedding") == dim, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col("chunk_id"))).cast("boolean"))
    version = spark.range(1).select(F.lit(name).alias("id"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("dim"), F.lit("cosine").alias("distance"), F.lit(chunker_name).alias("chunker_id"), F.lit(snapshot).alias("corpus_snapshot"), F.lit("chunks").alias("physical_table"), F.current_timestamp().alias("created_at"))
    alias = spark.range(1).select(F.lit("active").alias("alias"), F.lit(name).alias("index_version"), F.lit("chunks").alias("physical_table"), F.current_timestamp().alias("switched_at"))
    index.put(rows.where(right), version, alias)
    return index.chunks()


def refs_index(chunks: DataFrame) -> DataFrame:
    """One row: the sorted distinct references and the chunker. References are labels, not data: they are meant to fit one row."""
    return chunks.agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.max("chunker_id").alias("chunker_id"), F.count("*").alias("n_chunks"))


def known_articles(refs: DataFrame) -> DataFrame:
    return refs.select(article_of(F.col("ref")).alias("ref")).distinct()
