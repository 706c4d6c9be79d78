"""Versioned index tables: register, activate, upsert, purge, read.

An index is a folder of Parquet tables: ``chunks`` (partitioned by
index_version), ``versions`` and ``aliases``. Functions on DataFrames give the new
state; ``Index`` writes it to fresh folders and then commits a manifest that names
them, so that a reader sees the state before or after and never one between.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVE = "active"


def index_id(model: str, dim: int, chunker: str | None = None) -> str:
    """The name of a version; the default chunker isn't named."""
    from ..operators.chunking import ARTICLE

    return f"v1-{model}-{dim}" + ("" if chunker in (None, ARTICLE) else f"-{chunker}")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", updated: tuple[str, ...] = ("content", "embedding", "ordinal", "index_version")) -> DataFrame:
    """Old rows with ``updated`` columns taken from new ones of the same key, and the new ones besides."""
    mine = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in updated])
    kept = old.join(mine, F.col(key) == F.col("_k"), "left")
    kept = kept.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(key), key, "left_anti"))


def purge_other_versions(chunks: DataFrame, version: str) -> DataFrame:
    return chunks.where(F.col("index_version") == version)


def register(versions: DataFrame, row: DataFrame, key: str = "id") -> DataFrame:
    """Adds a version; one that is there already stays as it is."""
    return versions.unionByName(row.join(versions.select(key), key, "left_anti"))


def point_alias(aliases: DataFrame, row: DataFrame, key: str = "alias", order: str = "switched_at") -> DataFrame:
    """Adds or moves an alias: the latest row of each holds."""
    both = aliases.unionByName(row)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("r")).select("r.*")


def active(versions: DataFrame, aliases: DataFrame, alias: str = ACTIVE) -> DataFrame:
    """One row: the alias's index_version with its physical_table, model and width. No such alias fails the query."""
    one = aliases.where(F.col("alias") == alias).join(versions.select(F.col("id").alias("index_version"), "embedding_model", "dim"), "index_version")
    n = one.agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("index_version", "physical_table", "embedding_model", "dim")])
    return n.where(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no index behind alias {alias}")).cast("boolean")).otherwise(F.lit(True))).drop("n")


def bound_to_index(questions: DataFrame, index: DataFrame, model: str = "model", vector: str = "vector") -> DataFrame:
    """Questions whose vectors come from the index's own model and have its width; others fail the query."""
    both = questions.join(F.broadcast(index.select("embedding_model", "dim")))  # one row
    fits = (F.col(model) == F.col("embedding_model")) & (F.size(vector) == F.col("dim"))
    return both.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the question's embedder is not the index's")).cast("boolean"))).drop("embedding_model", "dim")


def metadata(chunker: Column, version: Column, in_force: Column) -> Column:
    """A chunk's provenance as JSON, keys sorted, nulls kept."""
    fields = {"chunker_id": chunker, "fecha_vigencia": in_force, "id_norma_version": version}
    return F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


# The columns of each table, their types, and whether they must have a value.
TABLES = {
    "versions": [("id", "string", True), ("embedding_model", "string", True), ("dim", "int", True), ("distance", "string", True), ("chunker_id", "string", True), ("corpus_snapshot", "string", True), ("physical_table", "string", True), ("created_at", "timestamp", True)],
    "aliases": [("alias", "string", True), ("index_version", "string", True), ("physical_table", "string", True), ("switched_at", "timestamp", True)],
    "chunks": [("chunk_id", "string", True), ("index_version", "string", True), ("content", "string", True), ("content_hash", "string", True), ("embedding", "array<double>", True), ("ref", "string", True), ("norma", "string", True), ("articulo", "string", False), ("apartado", "string", False)],
    "document_state": [("doc_id", "string", True), ("source_uri", "string", True), ("doc_hash", "string", True), ("state", "string", True), ("quarantine_reason", "string", False), ("n_chunks", "int", False), ("last_seen_at", "timestamp", True)],
}
NOW = ("created_at", "switched_at", "last_seen_at")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the columns of ``table`` first, cast to its types; others follow.

    A time that isn't given is now, any other missing column is an error, and a
    null where there must be a value, or a distance other than cosine, fails the query.
    """
    out = []
    for name, kind, needed in TABLES[table]:
        if name not in rows.columns and (needed and name not in NOW):
            raise ValueError(f"{table} has no column {name}")
        given = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        given = F.coalesce(given, F.current_timestamp()) if name in NOW else given
        wrong = given.isNull() if needed else F.lit(False)
        wrong = wrong | (given != "cosine") if name == "distance" else wrong
        out.append(F.when(wrong, F.raise_error(F.lit(f"{table}.{name} breaks its rule")).cast(kind)).otherwise(given).alias(name))
    known = {name for name, *_ in TABLES[table]}
    return rows.select(*out, *[c for c in rows.columns if c not in known])


def violations(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """(chunk_id, rule) of rows that break the table's constraints."""
    rules: dict[str, Column] = {
        "norma": F.col("norma").isNull(),
        "legal_ref": F.coalesce(F.trim("ref"), F.lit("")) == "",
        "content": F.coalesce(F.trim("content"), F.lit("")) == "",
    }
    if dim is not None:
        rules["embedding"] = F.coalesce(F.size("embedding") != dim, F.lit(True))
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return chunks.select("chunk_id", F.explode(broken).alias("rule"))


def document_state_violations(states: DataFrame) -> DataFrame:
    known = F.col("state").isin("indexed", "quarantined", "pending")
    reason = (F.col("state") == "quarantined") == F.col("quarantine_reason").isNotNull()
    return states.where(~F.coalesce(known & reason, F.lit(False)))


class Index:
    """Tables of an index under ``folder``, in any store that Spark writes and that renames.

    ``log`` holds numbered manifests: by table and part (index version, or nothing)
    the folder that holds it. The highest number counts; the one before stays for
    readers that have begun, and what only older ones name is deleted.
    """

    CHUNKS = "chunks"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, log = self._fs("log")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith("."))

    def _manifest(self, number: int) -> dict[str, dict[str, str]]:
        return json.loads(self.spark.read.text(f"{self.folder}/log/{number:012d}.json", wholetext=True).first()[0])

    def _now(self) -> dict[str, dict[str, str]]:
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {}

    def _commit(self, after: list[int], manifest: dict[str, dict[str, str]]) -> None:
        """Makes ``manifest`` the next one after the numbers that its writer saw; another writer's in between fails this one."""
        fs, fresh = self._fs(f"log/.{uuid.uuid4().hex}")
        _, final = self._fs(f"log/{after[-1] + 1 if after else 0:012d}.json")
        out = fs.create(fresh)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if fs.exists(final) or not fs.rename(fresh, final):
            fs.delete(fresh, False)
            raise OSError(f"{final} is there already: another writer was faster")
        named = lambda m: {f for parts in m.values() for f in parts.values()}
        keep = named(manifest) | (named(self._manifest(after[-1])) if after else set())
        for number in after[:-1]:
            for gone in named(self._manifest(number)) - keep:
                fs.delete(self._fs(gone)[1], True)
            fs.delete(self._fs(f"log/{number:012d}.json")[1], False)

    def _write(self, table: str, rows: DataFrame, partition: str | None = None) -> str:
        fresh = f"{table}-{uuid.uuid4().hex}"
        (rows.write.partitionBy(partition) if partition else rows.write).parquet(f"{self.folder}/{fresh}")
        return fresh

    def exists(self, table: str) -> bool:
        return table in self._now()

    def _read(self, parts: dict[str, str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{f}") for f in parts.values()])

    def read(self, table: str) -> DataFrame:
        return self._read(self._now()[table])

    def put(self, chunks: DataFrame, version: DataFrame, alias: DataFrame, keep_others: bool = False) -> None:
        """Upserts a version's chunks, registers it and points the alias at it, all with one commit; others go unless kept.

        Only the version's own part is written, and of the others those that give a
        chunk to it.
        """
        name = version.first()["id"]
        seen = self._numbers()
        now = self._manifest(seen[-1]) if seen else {}
        held = lambda table: self._read(now[table])
        old = held(self.CHUNKS) if self.CHUNKS in now else chunks.limit(0)
        rows = upsert(old, chunks)
        parts = {name: self._write(self.CHUNKS, purge_other_versions(rows, name), "index_version")}
        for other, folder in now.get(self.CHUNKS, {}).items() if keep_others else ():
            if other != name:
                own = old.where(F.col("index_version") == other)
                given = not own.join(chunks.select("chunk_id"), "chunk_id", "left_semi").isEmpty()
                left = rows.where(F.col("index_version") == other)
                if not given:
                    parts[other] = folder
                elif not left.isEmpty():
                    parts[other] = self._write(self.CHUNKS, left, "index_version")
        versions = register(held("versions"), version) if "versions" in now else version
        aliases = point_alias(held("aliases"), alias) if "aliases" in now else alias
        self._commit(seen, {self.CHUNKS: parts, "versions": {"": self._write("versions", versions)}, "aliases": {"": self._write("aliases", aliases)}})

    def chunks(self, alias: str = ACTIVE) -> DataFrame:
        """The chunks of the version behind an alias; the version is a partition, so others aren't read."""
        name = active(self.read("versions"), self.read("aliases"), alias).first()["index_version"]
        return self.read(self.CHUNKS).where(F.col("index_version") == name)
