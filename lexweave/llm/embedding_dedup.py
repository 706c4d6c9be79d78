"""Embedding near-dedup over the cells of a spherical k-means.

Equal vectors form a class, which goes on as its smallest id. Each class has a
home cell, that of the centroid with the highest cosine, and visits every other
cell whose centroid's cosine is less than ``MARGIN`` below it. Within a cell,
residents are compared with residents and visitors by blocked cosine products;
large cells are dealt into blocks of either, each pair of blocks in its own group. Tasks
report numbers of links and a spanning forest of what they linked, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, cut
from .components import components
from .ngram_join import _bounds, _groups

THRESHOLD = 0.9
#: How far below its home's a centroid's cosine may lie for a vector to visit its cell. Two vectors of cosine
#: 0.9 that differ in a random direction of 64 dimensions miss each other with probability under 0.001.
MARGIN, MARGIN_WIDTH = 0.15, 64
#: Vectors that the centroids are trained on, at most.
MAX_TRAINING_VECTORS = 16_384
#: Classes a cell should hold, and centroids, at most: one for each training vector. Beyond 8 million classes cells grow.
PER_CELL, MAX_CELLS = 512, MAX_TRAINING_VECTORS
#: Cosines with centroids that are held at a time.
HELD = 1 << 22
#: Centroids closer than this become one, so that one group of near copies has one cell.
SAME_CENTROID = 0.8
#: Residents, and residents with visitors, that one group compares.
RESIDENTS, COLUMNS = 1024, 4096
MEETING = ["cell", "i", "j", "side", "rep", "copies", "home", "cells", "x"]


def train_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors ``x``: spherical k-means from the first ``cells`` rows, then without near copies."""
    centroids = x[:cells].copy()
    strip = max(1, HELD // cells)
    for _ in range(rounds):
        home = np.concatenate([(x[at : at + strip] @ centroids.T).argmax(axis=1) for at in range(0, len(x), strip)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    kept, n = np.empty_like(centroids), 0
    for c in centroids:
        if not (kept[:n] @ c >= SAME_CENTROID).any():
            kept[n] = c
            n += 1
    return kept[:n]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, margin: float) -> Iterator[pa.RecordBatch]:
    """(rep, copies, x) to (rep, copies, x, home, cells): vectors of another width than the centroids' have home -width."""
    for b in batches:
        widths = np.array(b.column(2).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        home, cells = -widths, [[int(-w)] for w in widths]
        own = np.flatnonzero(widths == centroids.shape[1]) if len(centroids) else np.empty(0, dtype=np.int64)
        for at in np.array_split(own, max(1, -(-len(own) * len(centroids) // HELD))):
            if not len(at):
                continue
            cosine = _matrix(b.column(2).take(pa.array(at)), centroids.shape[1]) @ centroids.T
            best = cosine.argmax(axis=1)
            home[at] = best
            near = cosine >= cosine.max(axis=1, keepdims=True) - margin
            for i, row in zip(at.tolist(), near):
                cells[i] = np.flatnonzero(row).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["rep", "copies", "x", "home", "cells"])


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Groups (cell, i, j, side, rep, copies, home, cells, x), sorted, to exact links (rep, null, copies linked) and forest edges (a, b, 0).

    Side 0 holds residents of the cell, side 1 those of its residents and visitors that they meet in this group.
    """
    stride = 1 << 21
    for table in _groups(batches, 3):
        bounds = _bounds(table, 3)
        cell, _, _, side, rep, copies, home = (table.column(c).to_numpy() for c in range(7))
        home = home.astype(np.int64)
        cells, vectors = table.column(7).combine_chunks(), table.column(8).combine_chunks()
        ends: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            m = int(np.searchsorted(side[s:e], 1))
            if not 0 < m < e - s:
                continue
            x = _matrix(vectors.slice(s, e - s), len(vectors[s]))
            c = int(cell[s])
            visits = cells.slice(s, m)
            seen = np.repeat(np.arange(m), visits.value_lengths().to_numpy()) * stride + visits.flatten().to_numpy().astype(np.int64) % stride
            i, j = np.nonzero(x[:m] @ x[m:].T >= threshold)
            j += m
            ids, own, come = rep[s:e], copies[s:e], home[s:e]
            # Two residents meet both ways; a resident and a visitor may also meet in the visitor's home, then the smaller cell counts them.
            there = np.isin(i * stride + come[j] % stride, seen)
            keep = np.where(come[j] == c, ids[i] < ids[j], ~there | (c < come[j]))
            i, j = i[keep], j[keep]
            count = np.bincount(i, weights=own[j], minlength=e - s) + np.bincount(j, weights=own[i], minlength=e - s)
            some = np.flatnonzero(count)
            ends.append(np.stack([ids[some], count[some].astype(np.int64)]))
            forest = Forest()
            for a, b in zip(ids[i].tolist(), ids[j].tolist()):
                forest.union(a, b)
            if edges := forest.edges():
                pairs.append(np.array(edges, dtype=np.int64).T)
        e = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), dtype=np.int64)
        p = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
        second = pa.concat_arrays([pa.nulls(e.shape[1], pa.int64()), pa.array(p[1], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[0], p[0]]), pa.int64()), second, pa.array(np.concatenate([e[1], np.zeros(p.shape[1], dtype=np.int64)]), pa.int64())], names=["a", "b", "links"])


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None, max_training: int = MAX_TRAINING_VECTORS, per_cell: int = PER_CELL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id, kept: one row for each row of ``vectors``.

    Vectors of one width are linked if their cosine in double precision is
    ``threshold`` or more. ``n_links`` counts the other rows linked, copies
    included; ``component_id`` is the smallest id that links reach, itself
    included; ``kept`` says that this is the row's own. Vectors that are null,
    empty, zero or hold null or non-finite components are linked with nothing and
    kept; so is a row with a null id, whose component is null. Rows repeated under
    one id count as copies. Other columns are not read.

    Every row is indexed and every pair that meets is compared exactly; pairs that
    share no cell are missed (see ``MARGIN``; narrower vectors, whose pairs differ more in any
    one direction, get a margin as much wider, unless one is given), and no pair below the threshold is
    linked. Centroids are trained on the ``max_training`` classes with the smallest
    hashed ids.
    """
    # Floats stay floats until they are compared: that is exact, and half the size.
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    x = F.col(vector_col).cast(kind)
    fine = F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")).withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(F.col("x").cast("string"), 256)))
    classes = cut(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")))
    n = classes.count()
    width = classes.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    sample = classes.where(F.size("x") == width[0].w).orderBy(F.xxhash64("rep"), "rep").limit(max_training).select("x").toPandas()["x"] if width else []
    centroids = np.zeros((0, 0))
    if len(sample):
        unit = np.stack([np.asarray(v, dtype=float) for v in sample])
        centroids = train_centroids(unit / np.linalg.norm(unit, axis=1, keepdims=True), max(1, min(MAX_CELLS, math.ceil(n / per_cell), len(unit))))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    margin = margin if margin is not None else MARGIN * max(1.0, math.sqrt(MARGIN_WIDTH / width[0].w)) if width else MARGIN
    fields = f"rep bigint, copies bigint, x {kind}, home int, cells array<int>"
    placed = classes.select("rep", "copies", "x").mapInArrow(lambda b: _assigned(b, shared.value, margin), fields).withColumn("cell", F.explode("cells"))
    resident = F.col("home") == F.col("cell")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.when(resident, 1)) / RESIDENTS).cast("int").alias("rows"), F.ceil(F.count("*") / COLUMNS).cast("int").alias("columns"))
    dealt = placed.join(sizes, "cell").where("rows > 0")
    spread = F.xxhash64("rep")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    across = dealt.where(resident).withColumn("i", F.pmod(spread, F.col("rows")).cast("int")).withColumn("j", every("columns")).withColumn("side", F.lit(0))
    down = dealt.withColumn("j", F.pmod(spread, F.col("columns")).cast("int")).withColumn("i", every("rows")).withColumn("side", F.lit(1))
    meets = across.select(*MEETING).unionByName(down.select(*MEETING)).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "rep")
    exact = cut(meets.mapInArrow(lambda b: _linked(b, threshold), "a bigint, b bigint, links bigint"))

    links = exact.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(exact.where("b is not null")).withColumnRenamed("id", "rep")
    known = classes.select("key", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

