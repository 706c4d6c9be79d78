"""Building a set of cases: filters, quotas, seeded draws and deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from . import vector_index

# Classes of questions, and the shares of failure that part easy from hard.
COVERAGE_OF = {"positivo": "rgc", "negativo": "fuera"}
EASY, HARD = 6, 20
#: Near pairs of a component that one task goes through.
MAX_COMPONENT = 1_000_000


def draw_key(seed: str | int, *parts: Column) -> Column:
    """A number that stands for a random draw: md5, so that other engines can draw the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def difficulty(share: Column) -> Column:
    return F.when(share <= EASY, "facil").when(share >= HARD, "dificil").otherwise("media")


def usable(bank: DataFrame) -> DataFrame:
    return bank.where(F.col("depende_imagen") == "no")


def by_kind(bank: DataFrame, kind: str) -> DataFrame:
    return bank.where(F.col("cobertura_rgc") == COVERAGE_OF[kind])


def quota_plan(rows: DataFrame, total: int, subjects: int, subject: str = "tema") -> DataFrame:
    """(``subject``, available, quota): ``total`` split evenly over the most frequent subjects, what is left to the first ones.

    Subjects of equal size come by name. A subject with less than its quota is an error when it is drawn from.
    """
    sizes = rows.groupBy(subject).agg(F.count("*").alias("available"))
    top = sizes.orderBy(F.desc("available"), subject).limit(subjects)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("available"), subject)))  # ``subjects`` rows
    n = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("quota", (F.floor(F.lit(total) / n) + F.when(F.col("rn") <= F.lit(total) % n, 1).otherwise(0)).cast("int")).drop("rn")


def stratified_sample(rows: DataFrame, plan: DataFrame, seed: str | int, subject: str = "tema", id_col: str = "source_id", strict: bool = True) -> DataFrame:
    """Each subject's quota of rows with the least draw; with ``strict`` too small a subject fails the query."""
    quotas = plan.select(subject, "quota", "available")
    short = F.when(F.col("available") < F.col("quota"), F.raise_error(F.concat(F.lit("too few rows in "), F.col(subject).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    if strict:
        quotas = quotas.where(short)
    drawn = rows.join(F.broadcast(quotas.drop("available")), subject)  # one row for each planned subject
    order = Window.partitionBy(subject).orderBy(draw_key(seed, F.col(subject), F.col(id_col)), id_col)
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def blind_round_robin(rows: DataFrame, n: int, seed: str | int, subject: str = "tema", id_col: str = "id") -> DataFrame:
    """Adds a_ciegas, true for ``n`` rows taken round-robin over the subjects in order, by draw inside each."""
    turn = F.row_number().over(Window.partitionBy(subject).orderBy(draw_key(seed, F.col(subject), F.col(id_col)), id_col))
    chosen = rows.select(id_col, subject, turn.alias("turn")).orderBy("turn", subject, id_col).limit(n).select(id_col, F.lit(True).alias("_blind"))
    return rows.join(chosen, id_col, "left").withColumn("a_ciegas", F.coalesce("_blind", F.lit(False))).drop("_blind")


def near_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", lists: int | None = None) -> DataFrame:
    """(a, b, cosine) for a < b with a cosine of ``threshold`` or more; a row without a vector fails the query.

    Exact: all pairs are compared, block by block (``vector_index.pairs_within``). With
    ``lists`` a vector meets the blocks of an index with so many lists that can hold one so near, by
    the triangle inequality of angles, and no others; this suits narrow vectors and high
    thresholds, as a vector is sent to every shell that it meets.
    """
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col(id_col).cast("string"))).cast("array<double>")
    rows = written(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(F.col(vector_col).isNull(), missing).otherwise(F.col(vector_col).cast("array<double>")).alias("v")))
    if lists is None:
        return vector_index.pairs_within(rows, threshold)
    found = vector_index.build(rows, "id", "v", lists).within(rows, threshold)
    return found.where("q < id").select(F.col("q").alias("a"), F.col("id").alias("b"), "cosine")


def greedy_dedupe(rows: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows that going through them in order would keep, dropping each that is near one already kept.

    ``edges`` holds pairs a < b in that order. Rows without an undecided earlier neighbour are kept and their
    neighbours go, round by round, as long as each leaves fewer pairs by a tenth at least: so dense graphs are soon
    decided, whatever their components. Of what is left, long chains, what happens in one component of the
    pairs doesn't touch another, so a component is gone through in one task, in
    order, however long its chains are. Components of more than ``MAX_COMPONENT`` pairs, which
    no task should hold, are decided in rounds: an undecided row goes if an earlier neighbour is kept, and stays
    if all its earlier neighbours have gone.
    """
    own = written(edges.select("a", F.col("b").alias("id")).distinct())
    went, n = None, own.count()
    while n:
        first = own.select("a").distinct().join(own.select(F.col("id").alias("a")).distinct(), "a", "left_anti")
        out = written(own.join(first, "a", "left_semi").select("id").distinct())
        went = out if went is None else went.unionByName(out)
        own = written(own.join(out, "id", "left_anti").join(out.select(F.col("id").alias("a")), "a", "left_anti"))
        before, n = n, own.count()
        if n > 0.9 * before:
            break
    if not n:
        return rows if went is None else rows.join(went.withColumnRenamed("id", id_col), id_col, "left_anti")
    root = components(own.select("a", F.col("id").alias("b")))
    placed = written(own.join(root.select(F.col("id").alias("a"), "root"), "a"))
    sizes = written(placed.groupBy("root").agg((F.count("*") > MAX_COMPONENT).alias("large")))
    placed = placed.join(sizes, "root")
    kind = own.schema["id"].dataType.simpleString()

    def run(pairs: pa.Table) -> pa.Table:
        gone: set = set()
        kept_before: dict = {}
        for a, b in zip(*(pairs.column(c).to_pylist() for c in ("a", "id"))):
            kept_before.setdefault(b, []).append(a)
        for b in sorted(kept_before):
            if any(a not in gone for a in kept_before[b]):
                gone.add(b)
        return pa.table({"id": pa.array(list(gone), pairs.schema.field("id").type)})

    gone = placed.where("not large").select("root", "a", "id").groupBy("root").applyInArrow(run, f"id {kind}")
    if not sizes.where("large").isEmpty():
        gone = gone.unionByName(_gone_in_rounds(placed.where("large").select("a", "id")))
    return rows.join(gone.unionByName(went).withColumnRenamed("id", id_col), id_col, "left_anti")


def _gone_in_rounds(e: DataFrame) -> DataFrame:
    """The ids that go, a round at a time; each is checkpointed. At least the first undecided one is decided, so the rounds end."""
    e = written(e)
    state = written(e.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        # A row without earlier neighbours isn't in the state: it is kept.
        seen = e.join(state.select(F.col("id").alias("a"), F.col("kept").alias("a_kept"), F.lit(True).alias("known")), "a", "left")
        own = seen.groupBy("id").agg(F.max(F.when(F.col("known").isNull(), True).otherwise(F.col("a_kept"))).alias("some_kept"), F.count(F.when(F.col("known") & F.col("a_kept").isNull(), 1)).alias("open"))
        state = written(own.select("id", F.when(F.col("some_kept"), False).when(F.col("open") == 0, True).alias("kept")))
        if state.where("kept is null").isEmpty():
            return state.where("not kept").select("id")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in the pairs (a, b): the smallest id that pairs lead to.

    Each task first joins what its own pairs connect, which shortens long chains; then every id is
    led to the smallest of its neighbours' roots, and roots to each other, until nothing changes.
    The rounds grow with the logarithm of what is left of a chain.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        arrow = None
        for b in batches:
            arrow = b.column(0).type
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(a), find(c)
                parent.setdefault(a, a)
                parent[max(a, c)] = min(a, c)
        if arrow is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), arrow), pa.array([find(x) for x in parent], arrow)], names=["id", "root"])

    # Ids that lie near one another are often in one chain: sorted ranges of pairs hold its pieces.
    local = written(edges.repartitionByRange("a", "b").mapInArrow(joined, f"id {kind}, root {kind}"))
    links = local.where("id <> root").select("id", "root").distinct()
    while True:
        # Larger neighbours are led to the smallest one, then smaller ones: alternating stars.
        both = links.unionByName(links.select(F.col("root").alias("id"), F.col("id").alias("root")))
        least = both.groupBy("id").agg(F.min("root").alias("least")).select("id", F.least("id", "least").alias("least"))
        star = written(both.join(least, "id").where("root > id").select(F.col("root").alias("id"), F.col("least").alias("root")).distinct())
        down = written(star.groupBy("id").agg(F.min("root").alias("root")))
        again = star.join(down.withColumnRenamed("root", "least"), "id")
        small = written(again.where("root > least").select(F.col("root").alias("id"), F.col("least").alias("root")).unionByName(down).distinct())
        done = small.groupBy("id").count().where("count > 1").isEmpty() and small.join(small.select(F.col("id").alias("root")), "root", "left_semi").isEmpty()
        links = small
        if done:
            break
    every = local.select("id").unionByName(local.select(F.col("root").alias("id"))).distinct()
    return every.join(links, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def random_case(cases: DataFrame, seed: str | int, id_col: str = "id") -> DataFrame:
    """One case by draw: the same for the same seed."""
    return cases.orderBy(draw_key(seed, F.col(id_col)), id_col).limit(1)


def queue(rows: DataFrame, edges: DataFrame, total: int, subjects: int, seed: str | int, oversample: float = 1.25, subject: str = "tema", id_col: str = "source_id") -> DataFrame:
    """Draws more than is needed, drops near duplicates and trims each subject to its quota."""
    plan = quota_plan(rows, total, subjects, subject)
    wide = plan.withColumn("quota", F.least("available", F.ceil(F.col("quota") * oversample).cast("bigint")).cast("int"))
    drawn = greedy_dedupe(stratified_sample(rows, wide, seed, subject, id_col), edges, id_col)
    return stratified_sample(drawn, plan, seed, subject, id_col, strict=False)
