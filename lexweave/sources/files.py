"""Files of the evaluation tooling: question bank, cases, queues, proposals, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "id string, version int, pregunta string, respuesta_referencia string, refs array<string>, materia string, dificultad string, pct_fallo double, tipo string, provenance string, revisado_por string, revisado_en date, notas string"
QUEUE = "id string, source_id string, pregunta string, opciones array<string>, respuesta_correcta string, tema string, subtema string, pct_fallo double, tipo string, a_ciegas boolean"
VERDICTS = "id string, veredicto string, ref string, ref_agente string, coincide boolean, a_ciegas boolean, segundos double, en timestamp"


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The question bank: semicolons, a header, shares with a decimal comma."""
    bank = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"')
    return bank.withColumn("pct_fallo", F.replace("pct_fallo", F.lit(","), F.lit(".")).try_cast("double"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; a line that doesn't fit has nulls and its text in ``_bad``."""
    return spark.read.schema(f"{CASES}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE).json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts in the order of their lines: ``line_no`` grows within a file."""
    return spark.read.schema(VERDICTS).json(path).withColumn("line_no", F.monotonically_increasing_id())


def append_verdict(verdict: DataFrame, path: str) -> None:
    verdict.write.mode("append").json(path)


def proposals_of(files: DataFrame, name: str = "path", text: str = "value") -> DataFrame:
    """(id, ref, nota, negativo, responde) from JSON maps by id; keys that start with _ are left out, the last file wins."""
    entry = "map<string,struct<ref:string,nota:string,negativo:boolean,responde:string>>"
    rows = files.select(name, F.explode(F.from_json(F.col(text), entry)).alias("id", "p")).where(~F.col("id").startswith("_"))
    return rows.groupBy("id").agg(F.max_by("p", name).alias("p")).select("id", "p.*")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    return proposals_of(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()))


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("refs").alias("ref")).distinct()


def write_one(lines: DataFrame, path: str) -> None:
    """Text lines into one file; for reports and seals, which are small."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_cases(cases: DataFrame, path: str) -> str:
    """Writes cases as JSON lines in the order of their ids and returns the SHA-256 of the bytes."""
    ordered = cases.orderBy("id")
    write_one(ordered.select(F.to_json(F.struct(*sorted(c for c in cases.columns))).alias("value")), path)
    return cases.sparkSession.read.format("binaryFile").load(f"{path}/part-*").select(F.sha2("content", 256).alias("s")).first()["s"]


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
