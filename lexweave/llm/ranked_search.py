"""Ranked lexical search by Fagin's threshold algorithm.

A first pass writes the forward index: each document's number of terms, and how
often it has each term that some item asks for. Only sums go to the driver. Then
every task turns its documents into shards, a shard being bounded in postings: a list for each term, sorted by impact, beside the
forward rows. An item's lists are read round-robin; every document that shows up
is looked up in the forward index and scored in full; reading stops when the
threshold, the score that the last entries read would have together, falls
strictly below the k-th best score. A task passes its best from shard to shard, so that
later shards stop sooner, and sends on k rows for each item.

Texts never leave their task, and documents are not shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, give_back, small_batches, utf8

#: Different (item, term) pairs that go to the tasks at once; more items take further passes.
TERMS_PER_PASS = 1 << 20
#: Postings of a shard.
POSTINGS = 1 << 21
#: What a term consists of: ASCII letters and digits, and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Entries read from each list in the first turn; later turns read twice as many.
FIRST_READ = 16


def terms_of(text: Column) -> Column:
    """A text's terms, A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n: int, n_docs: int, n_terms: int) -> int:
    """m: a document's length against the mean, in hundredths, mixed with 1 at nine to one."""
    return 10 + (90 * n * n_docs) // n_terms


class Shard:
    """Impact-sorted lists and forward rows of a number of documents."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int, turn: np.ndarray) -> None:
        """``ends``: where documents' postings end; ``turn``: a document's place by id, for ties."""
        self.begin, self.terms, self.impacts, self.turn = np.concatenate([[0], ends]), terms, impacts, turn
        order = np.lexsort((-impacts, terms))
        self.docs, self.sorted = np.repeat(np.arange(len(ends)), np.diff(self.begin))[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def score(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Full scores, from the forward rows; each of ``docs`` has postings."""
        n = self.begin[docs + 1] - self.begin[docs]
        first = np.cumsum(n) - n
        at = np.repeat(self.begin[docs] - first, n) + np.arange(int(n.sum()))
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], first)

    def top(self, asked: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for the terms ``asked`` and their scores, by score and id.

        ``weights`` are 0 but for the terms asked. Documents that surely score below ``least`` may be left out.
        """
        begin, end = self.lists[asked], self.lists[asked + 1]
        worth = (end > begin) & (weights[asked] > 0)
        begin, end, w = begin[worth], end[worth], weights[asked][worth]
        seen = np.zeros(len(self.begin) - 1, bool)
        docs, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), begin, FIRST_READ
        while len(begin):
            stop = np.minimum(at + step, end)
            read = self.docs[np.concatenate([np.arange(a, b) for a, b in zip(at, stop)])]
            new = np.unique(read[~seen[read]])
            if len(new):
                seen[new] = True
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.score(new, weights)])
                docs, scores = self._best(docs, scores, k)
            left = stop < end
            threshold = int((w * self.sorted[stop - 1])[left].sum())  # nothing unseen is in a list that has been read to its end
            if not left.any() or threshold < least or (len(scores) == k and threshold < scores[-1]):
                break
            at, begin, end, w, step = stop[left], begin[left], end[left], w[left], step * 2
        return docs, scores

    def _best(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.turn[docs], -scores))[:k]
        return docs[order], scores[order]


def forward_index(docs: DataFrame, asked: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms and counts (32-bit integers) of every document with a term; of the terms only those ``asked``."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            rows, n, terms, counts = [], [], [], []
            for i, text in enumerate(utf8(b.column(1))):
                words = _TERM_BYTES.findall(text.lower()) if text else ()  # of bytes only A-Z has another case
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    rows.append(i)
                    n.append(len(words))
                    terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                    counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n bigint, terms binary, counts binary")


def _sums(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and in how many documents each term asked for stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            docs, total = docs + len(b), total + (pc.sum(b.column(0)).as_py() or 0)
            df += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32), minlength=n_terms)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there.tolist()], pa.int32()), pa.array([docs, total, *df[there].tolist()], pa.int64())], names=["term", "n"])

    rows = index.select("n", "terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    found = dict(zip(rows["term"], rows["n"]))
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _searched(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """item (its number), id, score: each task's best."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        own = np.zeros_like(weights)
        best: list[list[tuple]] = [[] for _ in items]

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            flat = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int32).astype(np.int64)
            ids, terms, tf = table.column("id").combine_chunks(), flat("terms"), flat("counts")
            size = pc.binary_length(table.column("terms")).to_numpy() // 4
            m = np.array([damping(n, n_docs, total) for n in table.column("n").to_pylist()], np.int64)
            turn = np.empty(len(ids), np.int64)
            turn[pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(ids))
            shard = Shard(np.cumsum(size), terms, 10**9 * tf // (1000 * tf + 8 * np.repeat(m, size)), len(weights), turn)
            for i, asked in enumerate(items):
                own[asked] = weights[asked]
                docs, scores = shard.top(asked, own, k, best[i][-1][0] if len(best[i]) == k else 1)
                own[asked] = 0
                if len(docs):
                    best[i] += zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())
                    best[i].sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                    del best[i][k:]

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += sum(map(len, b.column(2).to_pylist())) // 4
            if size >= POSTINGS:
                search(held)
                held, size = [], 0
        if held:
            search(held)
        found = [(i, d, s) for i, top in enumerate(best) for s, d in top if s > 0]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64())], names=["item", "id", "score"])
        give_back()

    id_type = index.schema["id"].dataType
    kind = to_arrow_type(id_type)
    return index.mapInArrow(run, f"item int, id {id_type.simpleString()}, score bigint")


def lexical_search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_col``, rank (from 1), ``id_col``, score: the k documents of the highest scores above 0 for each item, ties to the smaller id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums
    weight * (10**9 tf div (1000 tf + 8 m)) over the item's terms, once each, m being
    10 + 90 n N div L. N counts the documents with a term, L all their terms, n one
    document's. Null and empty texts have no terms and are not found; an item without terms
    finds nothing. Rows of one item id, null being one, are one item with the terms of all. Rows of
    one document id are each a document. Null ids come last among equal scores. Other columns are not read.

    Items go in passes of ``TERMS_PER_PASS`` terms, so that what is sent to the tasks is
    bounded; an item is never parted.
    """
    asked = cut(items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct())
    passes = max(1, -(-asked.count() // TERMS_PER_PASS))
    found = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        one = _pass(part, docs, k, item_col, id_col, text_col)
        found = one if found is None else found.unionByName(one)
    return found


def _pass(asked: DataFrame, docs: DataFrame, k: int, item_col: str, id_col: str, text_col: str) -> DataFrame:
    rows = asked.orderBy(F.col("item").asc_nulls_last(), "term").toArrow()
    names, of = [], []
    for i in rows.column("item").to_pylist():
        if not names or names[-1] != i:
            names.append(i)
        of.append(len(names) - 1)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    number = {t.encode(): i for i, t in enumerate(coded.dictionary.to_pylist())}
    terms, of = coded.indices.to_numpy().astype(np.int64), np.array(of, np.int64)
    items = np.split(terms, np.flatnonzero(np.diff(of)) + 1) if names else []
    index = cut(forward_index(small_batches(docs), number, id_col, text_col))
    n_docs, total, df = _sums(index, len(number))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    best = _searched(index, items, weights, n_docs, total, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kind = asked.schema["item"].dataType
    numbered = asked.sparkSession.createDataFrame(list(enumerate(names)), f"item int, name {kind.simpleString()}")
    return ranked.join(F.broadcast(numbered), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
