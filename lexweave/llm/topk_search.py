"""Exact top-k search over a bit-sliced index.

Each row's integer attributes are stored whole and, coarsened to a few bits, as
bit slices: one bitmap of the block's rows for each bit of each attribute. A
query's weights, coarsened too, are multiplied into the slices by shifted bitmap
additions, which give the slices of every row's coarse score at once. The k-th
highest coarse score is found from the most significant slice downward. What
coarsening can hide is bounded, so rows whose coarse score lies within that bound
of the k-th are kept beside it, and these boundary rows are scored exactly.
Vectors with attributes so large that a score could leave 64 bits stand beside the
index and are scored in integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released

BLOCK_ROWS = 8192
#: Queries of a part, at least, and visits that there should be, so that few index blocks don't keep most tasks idle.
BLOCK_QUERIES, VISITS = 64, 256
BITS = 5
QUERY_BITS = 4


class BitSlicedIndex:
    """The slices of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = BITS) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        self.n, self.dims = vectors.shape
        self.low = int(self.vectors.min(initial=0))
        self.step = max(1, -(-(int(self.vectors.max(initial=0)) - self.low + 1) // (1 << bits)))
        coarse = (self.vectors - self.low) // self.step
        words = -(-self.n // 64)
        self.valid = self._bitmap(np.ones((1, self.n), dtype=np.uint8), words)[0]
        self.slices = np.stack([self._bitmap((coarse.T >> b & 1).astype(np.uint8), words) for b in range(bits)])
        # The longest rest that coarsening leaves of a row, measured from the middle of a step, and the longest row.
        rest = self.vectors - self.low - coarse * self.step - (self.step - 1) / 2
        self.rest = float(np.sqrt((rest**2).sum(axis=1).max(initial=0)))
        self.length = float(np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1).max(initial=0)))

    @staticmethod
    def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        out = np.zeros((len(bits), words * 8), dtype=np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def score_slices(self, weights: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of each row's sum of weight times coarse attribute (its complement where ``negative``)."""
        flip = np.where(negative[:, None], self.valid, np.uint64(0))
        signed = self.slices ^ flip
        columns: list[list[np.ndarray]] = [[] for _ in range(int(weights.max(initial=0)).bit_length() + len(signed))]
        for shift in range(int(weights.max(initial=0)).bit_length()):
            at = np.flatnonzero(weights >> shift & 1)
            for b, slices in enumerate(signed):
                columns[b + shift].append(slices[at])
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        k = 0
        while k < len(columns) or carried:
            held = [*(columns[k] if k < len(columns) else []), *carried]
            column = np.concatenate(held) if held else np.zeros((0, len(self.valid)), dtype=np.uint64)
            carried = []
            while len(column) > 2:  # three bitmaps of one weight become a sum and a carry
                third = len(column) // 3
                x, y, z = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                half = x ^ y
                carried.append((x & y) | (half & z))
                column = np.concatenate([column[3 * third :], half ^ z])
            if len(column) == 2:
                carried.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0] if len(column) else np.zeros_like(self.valid))
            k += 1
        return out

    def kth(self, slices: list[np.ndarray], k: int, among: np.ndarray | None = None) -> int:
        """The k-th highest value of all rows or those in ``among``, from the most significant slice downward."""
        among, value, left = self.valid if among is None else among, 0, k
        for b in range(len(slices) - 1, -1, -1):
            ones = among & slices[b]
            count = int(np.bitwise_count(ones).sum())
            if count >= left:
                among, value = ones, value | 1 << b
            else:
                left -= count
                among = among & ~slices[b]
        return value

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """The positions of the rows whose value is ``bound`` or more."""
        above, equal = np.zeros_like(self.valid), self.valid
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal = equal & slices[b]
            else:
                above, equal = above | (equal & slices[b]), equal & ~slices[b]
        found = (above | equal) if bound > 0 else self.valid
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), count=self.n, bitorder="little"))

    def top(self, query: np.ndarray, own: int, k: int, query_bits: int = QUERY_BITS) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest rows whose id is not ``own``, ties to smaller ids; all if there are fewer."""
        query = query.astype(np.int64)
        size = np.abs(query)
        scale = max(1, -(-int(size.max(initial=0)) // ((1 << query_bits) - 1)))
        weights = (size + scale // 2) // scale
        slices = self.score_slices(weights, query < 0)
        # How far a row's score can lie from (scale * step) times its coarse one, besides what is the same for all rows.
        error = scale * float(np.linalg.norm(weights)) * self.rest + float(np.linalg.norm(size - scale * weights)) * self.length
        slack = int(2 * error / (scale * self.step)) + 2
        other = self.ids != own
        others = self._bitmap(other[None].astype(np.uint8), len(self.valid))[0]
        rows = self.at_least(slices, self.kth(slices, min(k, int(other.sum())), others) - slack)
        rows = rows[other[rows]]
        scores, ids = self.vectors[rows] @ query, self.ids[rows]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def attributes(x: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) of the rows of doubles, and which rows have none too large for 64-bit scores with each other."""
    with np.errstate(over="ignore"):
        q = np.floor(x * factor)
    bound = 2.0 ** ((62 - max(1, x.shape[1]).bit_length()) // 2)
    return q, (np.abs(q) < bound).all(axis=1)


def whole(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as Python's integers."""
    return np.array([math.floor(v * factor) if math.isfinite(v * factor) else int(v) * factor for v in x.tolist()], dtype=object)


class _Block:
    """The rows of one block and width: an index, and the rows that don't fit it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, factor: int) -> None:
        self.factor = factor
        q, narrow = attributes(x, factor)
        self.index = BitSlicedIndex(ids[narrow], q[narrow].astype(np.int64))
        self.wide = [(int(i), whole(v, factor)) for i, v in zip(ids[~narrow], x[~narrow])]

    def top(self, x: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k highest rows whose id is not ``own``, ties to smaller ids."""
        q, narrow = attributes(x[None], self.factor)
        if narrow[0]:
            ids, scores = self.index.top(q[0], own, k)
            found = list(zip(ids.tolist(), scores.tolist()))
        else:
            q = whole(x, self.factor)
            found = [(i, int(s)) for i, s in zip(self.index.ids.tolist(), self.index.vectors.astype(object) @ q if self.index.n else []) if i != own]
        if self.wide:
            q = whole(x, self.factor)
            found += [(i, int(v @ q)) for i, v in self.wide if i != own]
        return sorted(found, key=lambda f: (-f[1], f[0]))[:k] if self.wide or not narrow[0] else found


def ordered(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (score.bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - b for b in raw)


def _visits(batches: Iterator[pa.RecordBatch], k: int, factor: int) -> Iterator[pa.RecordBatch]:
    """(block, part, kind, id, x), sorted: a block's rows (kind 0) before the queries that visit it (kind 1); to (query_id, vec_id, score, sort key)."""
    at, held, blocks = None, [], None
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in range(3)])
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), keys.shape[1]]
        out: list[list] = [[], [], [], []]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            if at != (place := tuple(keys[:2, s])):
                at, held, blocks = place, [], None
            part = b.slice(s, e - s)
            ids, vectors = part.column(3).to_numpy(), _lists(part.column(4))
            if keys[2, s] == 0:
                held.append((ids, vectors))
                continue
            if blocks is None:
                every, rows = np.concatenate([i for i, _ in held] or [ids[:0]]), [v for _, x in held for v in x]
                widths = np.array([len(v) for v in rows], dtype=np.int64)
                blocks = {int(w): _Block(every[widths == w], np.stack([v for v in rows if len(v) == w]), factor) for w in np.unique(widths) if w}
                held = []
            for own, x in zip(ids.tolist(), vectors):
                for i, score in blocks[len(x)].top(x, own, k) if len(x) in blocks else []:
                    out[0].append(own)
                    out[1].append(i)
                    out[2].append(max(-(2**63), min(2**63 - 1, score)))
                    out[3].append(ordered(score))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["query_id", "vec_id", "score", "key"])


def topk_search(vectors: DataFrame, k: int = 10, query_every: int = 100, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each row whose id is divisible by ``query_every``: query_id, rank, vec_id, score of its k highest others.

    The score is the integer inner product of floor(factor * x), x as double; ties
    go to the smaller id; a query with fewer than k others gets all. Rows of
    different widths are not compared. Rows with a null id or a null vector, or
    with null or non-finite components, take no part. Scores beyond 64 bits rank
    exactly and are given as the nearest 64-bit integer. An id that comes twice
    counts as two candidates and one query (with the smaller vector). Other
    columns are not read.

    Rows are dealt into index blocks of about ``block_rows``; each query visits
    each index block, and only k rows of each visit are shuffled on. A block's
    queries are streamed past it, in parts where there are few blocks. Nothing is
    broadcast or collected.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats stay floats on the way: that is exact, and half the size
    fine = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("x")).where(F.coalesce(fine, F.lit(False)))
    n = rows.count()
    index_blocks = max(1, -(-n // block_rows))
    query_blocks = max(1, -(-n // (query_every * block_queries)))
    parts = min(query_blocks, max(1, -(-VISITS // index_blocks)))
    every = lambda m: F.explode(F.expr(f"sequence(0L, {m - 1}L)"))
    blocks = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(index_blocks)).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "x")
    asked = rows.where(F.pmod("id", F.lit(query_every)) == 0).groupBy("id").agg(F.min("x").alias("x"))
    asked = asked.select(every(index_blocks).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), "id", "x")
    meets = blocks.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    hits = meets.mapInArrow(released(lambda b: _visits(b, k, factor)), "query_id bigint, vec_id bigint, score bigint, key binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []
