"""A stored index of vectors: inverted lists by centroid, parted into shells of angle.

A vector stands in the list of the centroid nearest by angle, in the shell of that
angle, and in one of the shell's blocks, which are bounded in rows however hot a
list is. By the triangle inequality of angles a question at angle t from the
centroid is no nearer to a shell with angles from a to b than max(t - b, a - t).
A search visits a question's nearest lists first; the k-th distance found there tells
which other shells could hold something nearer, and these are visited too. Without
that second visit the search is approximate.

Questions meet lists by a shuffle join on list, shell and block. Only centroids
and shells, whose number is bounded, are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..checkpoints import written

#: Lists there are at most, and bytes of centroids; vectors that they are fitted to, at most, and rounds of fitting.
MAX_LISTS, MAX_CENTROID_BYTES, SAMPLE, ROUNDS = 4096, 64 << 20, 1 << 15, 5
#: Shells of a list, rows of a block, and questions that meet a block at once (where all rows are scanned: at all).
SHELLS, BLOCK_ROWS, QUESTIONS = 32, 8192, 4096
#: Where all pairs are compared: bytes of a block, blocks that a task's worth of rows is dealt to for the cores' sake and rows that are worth one, tasks at most,
#: cells of a product, and pairs that are looked at once more.
MET_BYTES, SPREAD, MET_ROWS, MET_TASKS, MET_CELLS, MET_PAIRS = 16 << 20, 12, 1024, 2000, 1 << 22, 1 << 16
#: Lists that each question visits first.
PROBES = 8
#: Rounding allowed for in a bound on angles; distances are rounded to ``DIGITS`` digits.
SLACK, DIGITS = 1e-6, 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class VectorIndex:
    """``entries``: list, shell, angle, id, v; ``shells``: list, shell, n, low, high, blocks; ``centroids``: a row for each list.

    Zero vectors, and those of another width than the centroids, are in the list
    minus their width less one; a question of that width visits it always. So are
    all vectors where there are no centroids, being few.
    """

    entries: DataFrame
    shells: DataFrame
    centroids: np.ndarray

    def search(self, questions: DataFrame, k: int, query_col: str = "query_id", query_vector: str = "vector", id_col: str = "id", probes: int = PROBES, exact: bool = True, skip_self: bool = False) -> DataFrame:
        """``query_col``, ``id_col``, distance, rank: the k smallest cosine distances, ties to the smaller id.

        Distances are rounded to 1e-12, so that copies of a vector tie wherever they
        are. A zero vector has distance 1 to all; null vectors are not compared, nor are those of different widths.
        Questions of one id are one question each time they stand there, unless they are equal. With
        ``skip_self`` an entry with the question's own id is left out.
        """
        asked = questions.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0)).select(F.col(query_col).alias("q"), _doubles(F.col(query_vector)).alias("v"))
        need = k + skip_self  # of a question's own entries there may be one among the best
        found = self._visit(self._targets(asked.withColumn("kth", F.lit(None).cast("double")), probes, True), need, skip_self)
        if exact and len(self.centroids) > probes:
            # The first visit's result is read twice: for the distances that it gives, and as a part of the result.
            found = written(found)
            far = Window.partitionBy("q").orderBy("distance", "id")
            kth = found.withColumn("n", F.row_number().over(far)).where(F.col("n") == need).select("q", F.col("distance").alias("kth"))
            more = self._targets(asked.join(kth, "q", "left"), probes, False)
            found = found.unionByName(self._visit(more, need, skip_self))
        order = Window.partitionBy("q").orderBy("distance", "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "distance", "rank")

    def within(self, questions: DataFrame, threshold: float) -> DataFrame:
        """q, id, cosine: every entry with a cosine of ``threshold`` or more, for questions (id, v). Blocks that can't hold one are not met."""
        asked = questions.select(F.col("id").alias("q"), _doubles(F.col("v")).alias("v"), F.lit(1.0 - threshold).alias("kth"))
        own, rest = self._targets(asked, 0, True), self._targets(asked, 0, False)
        return self._visit(own.unionByName(rest) if len(self.centroids) else own, None, False, threshold)

    def _targets(self, asked: DataFrame, probes: int, first: bool) -> DataFrame:
        """q, v, list, shell: what each question visits first, or afterwards, given the k-th distance ``kth`` found (null: fewer than k).

        First come the list of vectors that have no angle and the ``probes`` nearest lists; afterwards the others, as far as they can hold something so near.
        """
        if not len(self.centroids):
            return asked.where(F.lit(first)).select("q", "v", (F.lit(-1) - F.size("v")).alias("list"), F.lit(0).alias("shell"))
        spark = asked.sparkSession
        # At most MAX_LISTS lists of SHELLS shells.
        known = [(r["list"], r["shell"], r.low, r.high) for r in self.shells.where("list >= 0").select("list", "shell", "low", "high").collect()]
        table = np.array(sorted(known), dtype=float).reshape(-1, 4)
        shared = spark.sparkContext.broadcast((self.centroids, table))
        kind = asked.schema["q"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, table = shared.value
            lists, shells, low, high = table.T
            lists, shells = lists.astype(int), shells.astype(int)
            for b in batches:
                widths = b.column("v").value_lengths().to_numpy()
                at, to = [], []
                if first:
                    at, to = [np.arange(len(b))], [np.stack([-1 - widths, np.zeros(len(b), int)], axis=1)]
                here = np.flatnonzero(widths == centroids.shape[1])
                for part in np.array_split(here, max(1, -(-len(here) // 256))) if len(here) else ():
                    v = unit(_rows(b.column("v").take(pa.array(part)), centroids.shape[1]))
                    angle = np.arccos(np.clip(v @ centroids.T, -1, 1))
                    angle[(v == 0).all(axis=1)] = np.pi / 2
                    nearest = np.zeros(angle.shape, bool)
                    if probes:
                        np.put_along_axis(nearest, np.argpartition(angle, min(probes, angle.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
                    if first:
                        wanted = nearest[:, lists]
                    else:
                        kth = b.column("kth").take(pa.array(part)).fill_null(2.0).to_numpy()
                        reach = np.arccos(np.clip(1 - kth, -1, 1)) + SLACK
                        t = angle[:, lists]
                        wanted = ~nearest[:, lists] & (np.maximum(t - high, low - t) <= reach[:, None])
                        wanted |= ~nearest[:, lists] & (v == 0).all(axis=1)[:, None]
                    i, s = np.nonzero(wanted)
                    at.append(part[i])
                    to.append(np.stack([lists[s], shells[s]], axis=1))
                if at:
                    at, to = np.concatenate(at), np.concatenate(to)
                    yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(to[:, 0].astype(np.int32)), pa.array(to[:, 1].astype(np.int32))], names=["q", "v", "list", "shell"])

        return asked.mapInArrow(run, f"q {kind.simpleString()}, v array<double>, list int, shell int")

    def _visit(self, targets: DataFrame, k: int | None, skip_self: bool, threshold: float = 0.0) -> DataFrame:
        """q, id, distance: the k best of each block that a question visits; without ``k`` q, id, cosine of all that reach the threshold."""
        q_kind, id_kind = targets.schema["q"].dataType, self.entries.schema["id"].dataType
        arrow = to_arrow_type(q_kind), to_arrow_type(id_kind)
        targets, value = written(targets) if len(self.centroids) else targets, "cosine" if k is None else "distance"
        # How many blocks a shell has, and by how many groups of questions each is met.
        load = targets.groupBy("list", "shell").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("groups")).join(self.shells.select("list", "shell", "blocks"), ["list", "shell"])
        key = ["list", "shell", "block", "group"]
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
        left = self.entries.join(load, ["list", "shell"]).withColumn("block", own("blocks", "id", "v")).withColumn("group", each("groups")).select(*key, "id", "v")
        right = targets.join(load, ["list", "shell"]).withColumn("group", own("groups", "q", "v")).withColumn("block", each("blocks")).select(*[F.col(c).alias(f"{c}_") for c in key], "q", F.col("v").alias("asked"))

        def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(entries) or not len(asked):
                return pa.table({"q": pa.array([], arrow[0]), "id": pa.array([], arrow[1]), value: pa.array([], pa.float64())})
            ids, qs = entries.column("id").combine_chunks(), asked.column("q").combine_chunks()
            width = len(entries.column("v")[0])
            x = unit(_rows(entries.column("v").combine_chunks(), width))
            y = unit(_rows(asked.column("asked").combine_chunks(), width))
            if k is None:
                out = [_reaching(x, y[i : i + 256], threshold, i) for i in range(0, len(y), 256)]
            else:
                by_id = pc.rank(ids, null_placement="at_start", tiebreaker="first").to_numpy()
                out = [best(x, y[i : i + 256], by_id, k, i) for i in range(0, len(y), 256)]
            q, at, found = (np.concatenate(c) for c in zip(*out))
            return pa.table({"q": qs.take(pa.array(q)), "id": ids.take(pa.array(at)), value: pa.array(found)})

        found = left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_" for c in key])).applyInArrow(run, f"q {q_kind.simpleString()}, id {id_kind.simpleString()}, {value} double")
        return found.where("q <> id") if skip_self else found

    def write(self, path: str, version: str) -> None:
        """Writes the index as that of a version, which must not be there. Entries lie by list and shell."""
        folder = f"{path}/version={version}"
        spark = self.entries.sparkSession
        self.entries.repartition("list", "shell").sortWithinPartitions("list", "shell").write.parquet(f"{folder}/entries")
        self.shells.write.parquet(f"{folder}/shells")
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").write.parquet(f"{folder}/centroids")

    @staticmethod
    def read(spark: SparkSession, path: str, version: str) -> VectorIndex:
        folder = f"{path}/version={version}"
        rows = sorted(spark.read.parquet(f"{folder}/centroids").collect(), key=lambda r: r["list"])  # MAX_LISTS at most
        return VectorIndex(spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/shells"), np.array([r.centroid for r in rows], dtype=float).reshape(len(rows), -1))


def _reaching(x: np.ndarray, y: np.ndarray, threshold: float, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cosine = y @ x.T
    q, at = np.nonzero(cosine >= threshold)
    return q + first, at, cosine[q, at]


def best(x: np.ndarray, y: np.ndarray, by_id: np.ndarray, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``y`` the k nearest rows of ``x``: its number (from ``first``), theirs, and the distances. Of all that tie those of the smallest ids."""
    distance = np.round(1.0 - x @ y.T, DIGITS)
    keep = min(k, len(x))
    limit = np.partition(np.where(np.isnan(distance), np.inf, distance), keep - 1, axis=0)[keep - 1]
    at, q = np.nonzero(distance <= limit)
    order = np.lexsort((by_id[at], distance[at, q], q))
    at, q = at[order], q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    at, q = at[place < k], q[place < k]
    return q + first, at, distance[at, q]


def few(questions: DataFrame, query_col: str, query_vector: str) -> pa.Table | None:
    """q, v of the questions with a vector, if these are at most ``QUESTIONS`` and as many bytes as centroids may have."""
    asked = questions.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0)).select(F.col(query_col).alias("q"), _doubles(F.col(query_vector)).alias("v"))
    asked = written(asked)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    return asked.toArrow() if size.n <= QUESTIONS and 8 * size.components <= MAX_CENTROID_BYTES else None


def scan(asked: pa.Table, docs: DataFrame, k: int, query_col: str = "query_id", id_col: str = "id", vector_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """What ``VectorIndex.search`` finds, for ``few`` questions and without an index.

    Every row is compared in the task that reads it, which sends on what may be among a question's ``k`` best.
    """
    rows = docs.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), _doubles(F.col(vector_col)).alias("v"))
    qs, vectors = asked.column("q").combine_chunks(), asked.column("v").combine_chunks()
    widths = vectors.value_lengths().to_numpy()
    of = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    held = {w: (at, unit(_rows(vectors.take(pa.array(at)), w))) for w, at in of.items()}
    shared, need = docs.sparkSession.sparkContext.broadcast((qs, held)), k + skip_self
    q_kind, id_kind = from_arrow_type(qs.type).simpleString(), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, held = shared.value
        least = {w: np.full(len(at), np.inf) for w, (at, _) in held.items()}  # what the last of a question's best has at most
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy()
            for w, (at, y) in held.items():
                here, step = np.flatnonzero(lengths == w), max(need, MET_CELLS // len(y))
                for first in range(0, len(here), step):
                    part = b.take(pa.array(here[first : first + step]))
                    by_id = pc.rank(part.column("id"), null_placement="at_start", tiebreaker="first").to_numpy()
                    q, row, distance = best(unit(_rows(part.column("v"), w)), y, by_id, need)
                    good = distance <= least[w][q]
                    yield pa.RecordBatch.from_arrays([qs.take(pa.array(at[q[good]])), part.column("id").take(pa.array(row[good])), pa.array(distance[good])], names=["q", "id", "distance"])
                    full = np.bincount(q, minlength=len(y)) == need
                    last = np.full(len(y), -np.inf)
                    np.maximum.at(last, q, distance)
                    least[w] = np.where(full, np.minimum(least[w], last), least[w])

    found = rows.mapInArrow(run, f"q {q_kind}, id {id_kind}, distance double")
    found = found.where("q <> id") if skip_self else found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "distance", "rank")


def fit(vectors: DataFrame, width: int, n: int, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means over a sample by hash of at most 2 * ``SAMPLE`` vectors."""
    lists = max(1, min(lists, MAX_LISTS, MAX_CENTROID_BYTES // (8 * width)))
    most = min(SAMPLE, MAX_CENTROID_BYTES // (8 * width))
    share = max(1, n // most)
    taken = vectors.where(F.pmod(F.xxhash64("v", F.lit(17)), F.lit(share)) == 0).limit(2 * most).select("v").toArrow()
    x = unit(_rows(taken.column(0).combine_chunks(), width)) if len(taken) else np.empty((0, width))
    x = x[np.lexsort(x.T[:3])] if len(x) else x  # in an order of its own, whatever the partitions
    if len(x) <= lists:
        return unit(x.mean(axis=0, keepdims=True)) if len(x) else np.empty((0, width))
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(x[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-12, sums / np.where(lengths > 1e-12, lengths, 1), centroids)
    return centroids


def build(docs: DataFrame, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None) -> VectorIndex:
    """The index of all rows of ``docs`` with a vector. Its width is that of most vectors; ``lists`` is about the square root of their number, and 1 for a block or less."""
    rows = docs.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), _doubles(F.col(vector_col)).alias("v"))
    main = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, n = (main["w"], main["count"]) if main else (1, 0)
    lists = lists or (1 if n <= BLOCK_ROWS else round(n**0.5))
    if lists == 1:
        entries = rows.select((F.lit(-1) - F.size("v")).alias("list"), F.lit(0).alias("shell"), F.lit(0.0).alias("angle"), "id", "v")
        return VectorIndex(entries, _shells(entries), np.empty((0, width)))
    zero = F.forall("v", lambda x: x == 0)
    centroids = fit(rows.where((F.size("v") == width) & ~zero), width, n, lists)
    shared = docs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for b in batches:
            widths = b.column("v").value_lengths().to_numpy()
            to, angle = -1 - widths.astype(np.int32), np.zeros(len(b))
            here = np.flatnonzero(widths == width) if len(centroids) else []
            for part in np.array_split(here, max(1, -(-len(here) // 1024))) if len(here) else ():
                v = unit(_rows(b.column("v").take(pa.array(part)), width))
                dots, there = v @ centroids.T, ~(v == 0).all(axis=1)
                nearest = dots.argmax(axis=1)
                to[part[there]] = nearest[there]
                angle[part[there]] = np.arccos(np.clip(dots[np.arange(len(v)), nearest], -1, 1))[there]
            shell = np.minimum(angle / np.pi * SHELLS, SHELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(shell), pa.array(angle), b.column("id"), b.column("v")], names=["list", "shell", "angle", "id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    entries = written(rows.mapInArrow(run, f"list int, shell int, angle double, id {kind}, v array<double>"))
    return VectorIndex(entries, written(_shells(entries)), centroids)


def _shells(entries: DataFrame) -> DataFrame:
    return entries.groupBy("list", "shell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))


def pairs_within(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, cosine: every two rows (id, v) of one width with a < b and a cosine of ``threshold`` or more.

    For wide vectors and low thresholds, where hardly a list can be left out. Rows are dealt
    into blocks bounded in bytes, and every two blocks meet in a task, so a row is shuffled once for
    each block of its width and no more. All pairs are compared: in single precision first, and what may reach the threshold in double.
    """
    rows = rows.where(F.size("v") > 0).select("id", _doubles(F.col("v")).alias("v"), F.size("v").alias("width"))
    most = F.greatest(F.lit(1), F.floor(F.lit(MET_BYTES) / (8 * F.col("width"))))
    sizes = written(rows.groupBy("width").agg(F.count("*").alias("n")).select("width", F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(SPREAD), F.ceil(F.col("n") / MET_ROWS))).cast("int").alias("blocks")))
    tasks = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = _dealt(rows, sizes).repartition(int(min(tasks, MET_TASKS)), "width", "i", "j").sortWithinPartitions("width", "i", "j")

    def met(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        width, i, j = (table.column(c)[0].as_py() for c in ("width", "i", "j"))
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        x = unit(_rows(table.column("v").combine_chunks(), width))
        less, near = x.astype(np.float32), threshold - 1e-6 - 2e-7 * width
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        step = max(1, MET_CELLS // max(1, len(right)))
        for first in range(0, len(left), step):
            some = left[first : first + step]
            p, q = np.nonzero(less[some] @ less[right].T >= near)
            if i == j:
                p, q = p[q > p + first], q[q > p + first]
            for k in range(0, len(p), MET_PAIRS):
                a, b = some[p[k : k + MET_PAIRS]], right[q[k : k + MET_PAIRS]]
                cosine = np.einsum("ij,ij->i", x[a], x[b])
                good = (cosine >= threshold) & (ids[a] != ids[b])
                a, b = ids[a[good]], ids[b[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine[good])], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("width", "i", "j")])
            edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), len(b)]
            for s, e in zip(edges[:-1], edges[1:]):
                if e > s:
                    if held and key[:, s].tolist() != at:
                        yield from met(held)
                        held = []
                    at = key[:, s].tolist()
                    held.append(b.slice(s, e - s))
        if held:
            yield from met(held)

    return dealt.mapInArrow(run, "a bigint, b bigint, cosine double")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """width, i, j, own, id, v: each row in its own block, once for each block that it meets; i is the smaller number of the two."""
    own = rows.join(sizes, "width").withColumn("own", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("width", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")


def recall(found: DataFrame, exact: DataFrame, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """``query_col``, n, found: how many of a question's exact neighbours a search has found."""
    hits = exact.select(query_col, id_col).join(found.select(query_col, id_col, F.lit(1).alias("hit")), [query_col, id_col], "left")
    return hits.groupBy(query_col).agg(F.count("*").alias("n"), F.count("hit").alias("found"))
