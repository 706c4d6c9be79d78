"""Vectors as short codes: a part of a vector becomes the number of its codebook's nearest entry.

Components become integers, floor(1024 * x), and a vector is cut into equal
consecutive parts, each with a codebook of its own. Entries are filtered from
coarse to fine: a part is cut into 1, 2, 4 blocks, and for a block of n components
with mean m and residual norm r (the length of what is left without the mean)

    n * (m - m')**2 + (r - r')**2 <= squared distance

by the triangle inequality. An entry whose sum of these is above a distance that
some entry has can't be nearest; rounding is allowed for, so none is lost. What
survives gets its exact distance in integers.

Codebooks are bounded (``entries`` by the vector's width), so they go through the
driver and to every task; vectors never do, and nothing but sums for each entry
is shuffled in training.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 1024
#: Parts compared at once, and into how many blocks they are cut, from coarse to fine.
AT_ONCE, LEVELS = 512, (1, 2, 4)
#: Rounding allowed for in a lower bound, as a share of the squared lengths.
SLACK = 1e-9


def largest(width: int) -> int:
    """The largest component for which a vector's error surely fits 64 bits."""
    return int((2**62 / (4 * width)) ** 0.5)


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has the width and only components that can be coded."""
    return F.coalesce((F.size(vector) == width) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < largest(width) / SCALE, F.lit(False))), F.lit(False))


def common_width(vectors: DataFrame, vec_col: str, parts: int) -> int | None:
    """The width of most vectors that can be cut into the parts, of equally many the smaller."""
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("w")).count().where((F.col("w") > 0) & (F.col("w") % parts == 0))
    first = sizes.orderBy(F.desc("count"), "w").first()
    return first and first.w


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """Integer components, a row for each vector."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE).astype(np.int64).reshape(-1, width)


def outline(x: np.ndarray, blocks: int) -> np.ndarray:
    """Weighted mean and residual norm of each block, side by side: distances between outlines bound those between parts from below."""
    out = []
    for block in np.array_split(x.astype(float), min(blocks, x.shape[1]), axis=1):
        mean = block.mean(axis=1)
        out += [mean * block.shape[1] ** 0.5, np.sqrt(((block - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


class Codebook:
    """The entries of one part, with their outlines."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.outlines = [outline(entries, b) for b in LEVELS]
        self.longest = float((entries.astype(float) ** 2).sum(axis=1).max(initial=0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and its squared distance."""
        found = [self._nearest(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack = SLACK * ((x.astype(float) ** 2).sum(axis=1) + self.longest)
        n, k = len(x), len(self.entries)
        bound = np.full(n, np.inf)  # a distance that some entry has
        row, entry = np.divmod(np.arange(n * k), k)
        for level, blocks in enumerate(LEVELS):
            own, theirs = outline(x, blocks), self.outlines[level]
            if level == 0:
                below = sum((own[:, f, None] - theirs[None, :, f]) ** 2 for f in range(own.shape[1])).ravel()
            else:
                below = ((own[row] - theirs[entry]) ** 2).sum(axis=1)
            first = _first_least(row, below)
            bound = np.minimum(bound, self._exact(x, row[first], entry[first]))
            alive = below <= (bound + slack)[row]
            row, entry = row[alive], entry[alive]
        distance = self._exact(x, row, entry)
        first = _first_least(row, distance)
        return entry[first], distance[first]

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x[row] - self.entries[entry]) ** 2).sum(axis=1)


def _first_least(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For ascending rows, where the first of each row's least values stands."""
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.repeat(np.minimum.reduceat(value, begin), np.diff(begin, append=len(row)))
    at = np.flatnonzero(value == least)
    return at[np.flatnonzero(np.diff(row[at], prepend=-1))]


def train(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, width: int | None = None) -> list[np.ndarray]:
    """A codebook for each part: that part of the vectors with the smallest ids, then ``rounds`` of assigning and averaging.

    An entry becomes floor(sum / count) of the parts assigned to it; one without
    parts stays. Of vectors with equal ids the smaller by components comes first,
    null ids come last. Fewer vectors than ``entries`` make fewer entries.
    """
    width = width or common_width(vectors, vec_col, parts)
    if not width:
        return []
    kept = vectors.where(usable(F.col(vec_col), width)).select(F.col(vec_col).alias("v"), F.col(id_col).alias("id"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = quantised(first.column(0).combine_chunks(), width) if len(first) else np.empty((0, width), np.int64)
    books = [np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)]
    for _ in range(rounds if len(start) else 0):
        books = _averaged(kept.select("v"), books, width)
    return books


def _averaged(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Each entry as the mean of its parts. A task adds up its own; Spark adds these."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Codebook(b) for b in shared.value]
        sums, counts = [np.zeros_like(b) for b in shared.value], [np.zeros(len(b), np.int64) for b in shared.value]
        for b in batches:
            for p, x in enumerate(np.split(quantised(b.column(0), width), len(mine), axis=1)) if len(b) else ():
                code = mine[p].nearest(x)[0]
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums[p][code[order][begin]] += np.add.reduceat(x[order], begin, axis=0)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            cell, place = np.repeat(used, s.shape[1]), np.tile(np.arange(s.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), p, np.int32)), pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(s[used].ravel()), pa.array(np.repeat(n[used], s.shape[1]))], names=["part", "entry", "place", "s", "n"])

    made = kept.mapInArrow(run, "part int, entry int, place int, s bigint, n bigint")
    exact = F.sum(F.col("s").cast("decimal(20,0)"))  # 64 bits may be too few for all tasks' sums
    rows = made.groupBy("part", "entry", "place").agg(exact.alias("s"), F.sum("n").alias("n")).toArrow().to_pydict()
    books = [b.copy() for b in books]
    for p, e, i, s, n in zip(*rows.values()):
        books[p][e, i] = int(s) // n if isinstance(s, Decimal) else s // n
    shared.unpersist()
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col``, ``label_col``, codes (an index for each part), error (squared distances summed over parts) of every vector that can be coded."""
    ids, labels = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    width = sum(b.shape[1] for b in books) or 1
    kept = vectors.where(usable(F.col(vec_col), width)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Codebook(b) for b in shared.value]
        for b in batches:
            if len(b):
                found = [mine[p].nearest(x) for p, x in enumerate(np.split(quantised(b.column(2), width), len(mine), axis=1))]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, len(mine), dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed, pa.array(sum(f[1] for f in found))], names=["id", "label", "codes", "error"])

    coded = kept.mapInArrow(run, f"id {ids}, label {labels}, codes array<int>, error bigint")
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(``id_col``, ``label_col``, codes, error, label_error) for each vector that can be coded, and the codebooks.

    label_error is the error summed over all rows with the label, null being one; it is
    null where 64 bits don't hold it. Left out are vectors that are null or hold null or non-finite
    components, those of another width than most (or one that can't be cut into
    ``parts``), and those with components so large (over 131072 at 64 components) that no
    64-bit error could be given. Rows that are repeated are each coded; without vectors
    the result is empty and so are the codebooks. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has 1 to 256 entries")
    books = train(vectors, id_col, vec_col, parts, entries, rounds)
    coded = cut(encode(vectors, books, id_col, vec_col, label_col))
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    # A plain join of two shuffled sides: adaptive execution parts the rows of a label that many have.
    return coded.join(sums, coded[label_col].eqNullSafe(sums["_label"])).drop("_label"), books


def hexadecimal(codes: Column) -> Column:
    """Codes as two hexadecimal digits each, in the order of the parts."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def books_sha256(books: list[np.ndarray]) -> str:
    """The digest of all entries' components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
