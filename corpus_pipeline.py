"""A corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns of
``documents``, on all that the stage before has kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import secrets
from lexweave.llm.bpe_automaton import bpe_encode
from lexweave.llm.common import cut, read_table, small_batches
from lexweave.llm.mixing import mix_sources
from lexweave.llm.ngram_join import keep_one
from lexweave.llm.quality import quality_classifier
from lexweave.llm.queries import WEIGHTS


def kept_apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose own columns of these names are called something else meanwhile."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    out = work(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no perplexity and stay; a null or unknown language is
    judged by all languages' thresholds; rows that are repeated are judged alike;
    without labels all stay.
    """
    labels = read_table(spark, sf_dir, "labels")
    return kept_apart(docs, ("bits_per_char", "perplexity", "threshold", "kept"), lambda d: quality_classifier(d, labels).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Five words, similarity 0.8 or more. Null, empty and blank texts are near
    nothing; rows with a null id stay; rows equal in id and text stay once, and
    each text of an id with several is a document by itself.
    """
    return keep_one(small_batches(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, null and empty texts as they are.

    n_chars is that of the new text where one was replaced, else what it was.
    """
    model = secrets.train(secrets.labelled_findings(spark))
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("secrets") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return kept_apart(docs, ("n_candidates", "secrets", "redacted"), lambda d: secrets.secret_scan(d, model).withColumns(changed))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are put into the order of the mixture; every row stays.

    Rows of a source without a weight, and with none, share the weight of others;
    rows equal in id stand side by side.
    """
    return kept_apart(docs, ("mix_source", "block", "slot", "position"), lambda d: mix_sources(d, WEIGHTS).orderBy("position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers), a row for each of ``docs``, in their order.

    Null and empty texts have no tokens; repeated rows each get theirs.
    """
    return bpe_encode(small_batches(docs)).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't express the classifier, the forest or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written to the shared folder and read from there."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
