"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Copies of one text form a class, which goes on
as its smallest id. Each class gets MinHash values; classes that agree on a whole
band of them are candidates. A pair's values are compared bit by bit: as soon as
the posterior probability that its similarity reaches the threshold falls below
the tolerance, the pair is dropped. What is left is joined into clusters, and
within clusters all pairs are verified exactly on their shingle sets.

Pairs are never emitted: a task reports each class's number of links and a
spanning forest of what it has linked, both linear in its input. Large buckets
are chained to their smallest member, which only makes clusters larger; large
clusters are verified in blocks, each pair of blocks in its own group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, by_bytes, cut, gram_hashes, released, utf8, word_hashes, word_spans
from .components import components

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
COMPARED = (16, 32, 64, 96, 128)
#: Buckets with more classes are chained instead of compared.
LARGE_BUCKET = 256
#: Classes, and shingles, in a block of a cluster. A text goes to as many groups as its cluster has blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words as sorted 64-bit hashes; of a shorter text all its words are one."""
    for _, part in by_bytes(texts):
        buf = b"\n".join(part)
        starts, ends = word_spans(buf)
        words = word_hashes(buf, starts, ends)
        grams = gram_hashes(words, k)
        edge = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s >= k:
                yield np.unique(grams[s : e - k + 1])
            else:
                yield gram_hashes(words[s:e], int(e - s)) if e > s else grams[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, four to a 64-bit band."""
    low = shingles.astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 8192):
        np.minimum(best, (low[i : i + 8192, None] * _FACTORS + _TERMS).min(axis=0), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").view("<i8")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the matches below which a pair is dropped.

    With an even prior the posterior P(similarity >= t | m of n match) is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in COMPARED:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches by equal first ``keys`` columns, in tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), dtype=bool)
        for c in range(keys):
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(c)[len(held[-1]) - 1].as_py() != v[0]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if change.any():
            if held or last:
                yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.ones(len(table), dtype=bool)
    if len(table):
        change[1:] = False
        for c in range(keys):
            v = table.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(table))


def _pruned(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Buckets (band, value, id, shingles, signature), sorted, to the forest of the pairs that pruning leaves."""
    least = least_matches(threshold, tolerance)
    for table in _groups(batches, 2):
        band = table.column(0).to_numpy()
        ids = table.column(2).to_numpy()
        sizes = table.column(3).to_numpy().astype(np.float64)
        bands = table.column(4).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        values = np.ascontiguousarray(bands).view("<u2").reshape(-1, BANDS * ROWS)
        bounds = _bounds(table, 2)
        forest: list[tuple[int, int]] = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
            fit = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
            if band[s]:  # pairs that share an earlier bucket have been compared there
                fit &= ~(bands[i, : band[s]] == bands[j, : band[s]]).any(axis=1)
            i, j = i[fit], j[fit]
            matches, done = np.zeros(len(i), dtype=np.int32), 0
            for n in COMPARED:
                if not len(i):
                    break
                matches += (values[i, done:n] == values[j, done:n]).sum(axis=1, dtype=np.int32)
                alive = matches >= least[n]
                i, j, matches, done = i[alive], j[alive], matches[alive], n
            if len(i) == 1:
                forest.append((ids[i[0]], ids[j[0]]))
            elif len(i):
                f = Forest()
                for x, y in zip(ids[i].tolist(), ids[j].tolist()):
                    f.union(x, y)
                forest.extend(f.edges())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), pa.array([y for _, y in forest], pa.int64())], names=["a", "b"])


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``left`` shares with each of ``right``; both name all sets, or each set is in one of them."""
    m = len(sets)
    every = np.concatenate(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    rows, column = rows[keep], number[column[keep]]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = max(256, (1 << 22) // m)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = int(common.sum())
    for at in range(0, total, width):
        s, e = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, min(width, total - at)), dtype=np.float32)
        x[rows[s:e], column[s:e] - at] = 1
        out += x[left] @ x[right].T
    return out


def _verified(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Groups (cluster, i, j, block, id, copies, text), sorted, to exact links: (id, null, copies linked) and forest edges (a, b, 0)."""
    for table in _groups(batches, 3):
        bounds = _bounds(table, 3)
        left, right, block, ids, copies = (table.column(c).to_numpy() for c in range(1, 6))
        texts = utf8(table.column(6).combine_chunks())
        out: list[list] = [[], [], []]
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s < 2:
                continue
            sets = list(shingle_sets(texts[s:e], k))
            n = np.array([len(x) for x in sets], dtype=np.float64)
            # One block is compared with itself, or the texts of one with those of another.
            alone = left[s] == right[s]
            here = np.arange(e - s) if alone else np.flatnonzero(block[s:e] == left[s])
            there = here if alone else np.flatnonzero(block[s:e] == right[s])
            linked = _shared(sets, here, there) * (1 + threshold) >= threshold * (n[here, None] + n[None, there]) - 1e-9
            if alone:
                np.fill_diagonal(linked, False)
            own, times, count = ids[s:e], copies[s:e], np.zeros(e - s, dtype=np.int64)
            count[here] = linked @ times[there]
            if not alone:
                count[there] = linked.T @ times[here]
            for x in np.flatnonzero(count).tolist():
                out[0].append(int(own[x]))
                out[1].append(None)
                out[2].append(int(count[x]))
            f = Forest()
            i, j = np.nonzero(np.triu(linked) if alone else linked)
            for x, y in zip(own[here[i]].tolist(), own[there[j]].tolist()):
                f.union(x, y)
            for x, y in f.edges():
                out[0].append(x)
                out[1].append(y)
                out[2].append(0)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rep_id, class_id, n_links: one row for each row of ``docs`` with an id.

    Two rows are linked if their texts' sets of ``words``-word shingles have a
    Jaccard similarity of ``threshold`` or more. ``n_links`` counts the other
    documents linked, copies included; ``rep_id`` is the smallest id with the same text and
    ``class_id`` the smallest id that links reach. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; a text of fewer words is one shingle of them
    all. A null, empty or blank text has no shingles and is linked with nothing,
    not even its copies. Rows with a null id take no part and don't appear. Rows
    with one id are one document: it counts once, with the text of the smallest
    MD5, and each of them gets its result. Other columns are not read.

    Candidates miss a pair at the threshold with probability (1 - t**4)**32 (5e-8
    at 0.8) and pruning drops one with ``tolerance``; what is reported is exact but
    for equal 64-bit hashes of different shingles.
    """
    key = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.concat(F.lit("null "), F.col(id_col).cast("string")))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(utf8(b.column(1)), words)) if len(b) else []
            signed = [signature(s) for s in sets]
            flat = np.concatenate(signed) if signed else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), lists], names=["key", "size", "sig"])

    signed = source.select("key", "text").mapInArrow(released(sign), "key string, size int, sig array<bigint>")
    own = cut(source.select("id", "key").groupBy("id").agg(F.min("key").alias("key")))
    signatures = signed.groupBy("key").agg(F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = cut(own.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).join(signatures, "key"))

    bands = classes.where("size > 0").select("rep", F.posexplode("sig").alias("band", "value"))
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("members"), F.min("rep").alias("low")).where("members > 1")
    found = bands.join(buckets, ["band", "value"])
    chained = found.where(F.col("members") > LARGE_BUCKET).select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    small = found.where(F.col("members") <= LARGE_BUCKET).select("band", "value", "rep").join(classes.select("rep", "size", "sig"), "rep")
    small = small.select("band", "value", "rep", "size", "sig").repartition("band", "value").sortWithinPartitions("band", "value", "rep")
    near = small.mapInArrow(released(lambda b: _pruned(b, threshold, tolerance)), "a bigint, b bigint")
    clusters = cut(components(near.unionByName(chained)))

    members = clusters.withColumnRenamed("id", "rep").join(classes.select("rep", "copies", "size"), "rep")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = source.select(F.col("id").alias("rep"), "key", "text").join(members.join(classes.select("rep", "key"), "rep"), ["rep", "key"]).dropDuplicates(["rep"])
    meets = texts.select("component", "block", "rep", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "text")
    meets = meets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    exact = cut(meets.mapInArrow(released(lambda b: _verified(b, words, threshold)), "a bigint, b bigint, links bigint"))

    links = exact.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(exact.where("b is not null")).withColumnRenamed("id", "rep")
    known = classes.select("key", "rep", "copies", "size").join(links, "rep", "left").join(groups, "rep", "left")
    has = F.col("size") > 0
    told = own.join(known, "key").select(
        F.col("id"),
        F.when(has, F.col("rep")).otherwise(F.col("id")).alias("rep_id"),
        F.when(has, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("class_id"),
        F.when(has, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
    )
    return source.select("id").join(told, "id").withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; its columns as they are.

    Rows repeated with the same id and text stay once; rows with a null id stay.
    Where an id has several texts, each of them is a document, judged by itself;
    of those in one group that of the smallest MD5 stays.
    """
    key = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit("null"))
    named = docs.where(F.col(id_col).isNotNull())
    units = named.select(F.col(id_col).cast("bigint").alias("_keep_id"), key.alias("_keep_key"))
    if units.groupBy("_keep_id").agg((F.min("_keep_key") < F.max("_keep_key")).alias("several")).where("several").isEmpty():
        gone = ngram_join(docs, id_col=id_col, text_col=text_col, **options).where(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
        left = named.join(gone, id_col, "left_anti")
    else:
        units = cut(cut(units.distinct()).withColumn("_keep_unit", F.monotonically_increasing_id()))  # numbers that stay as they are
        texts = named.select(F.col(id_col).cast("bigint").alias("_keep_id"), key.alias("_keep_key"), F.col(text_col)).join(units, ["_keep_id", "_keep_key"]).select("_keep_unit", text_col)
        found = ngram_join(cut(texts), id_col="_keep_unit", text_col=text_col, **options).select("_keep_unit", "class_id").distinct()
        groups = cut(units.join(found, "_keep_unit"))
        first = groups.groupBy("class_id").agg(F.min(F.struct("_keep_id", "_keep_key")).alias("first"))
        gone = groups.join(first, "class_id").where(F.struct("_keep_id", "_keep_key") != F.col("first")).select("_keep_id", "_keep_key")
        left = named.withColumns({"_keep_id": F.col(id_col).cast("bigint"), "_keep_key": key}).join(gone, ["_keep_id", "_keep_key"], "left_anti")
    left = left.dropDuplicates([id_col, text_col])
    return left.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
