"""A stored inverted index with positions, and searches that read the asked terms only.

A posting is a term's places in a document. Documents are dealt into blocks, and for
each term and block the index keeps the most that a document of the block has. The sum
of these over a question's terms bounds what any document of the block can score, so a search
scores a question's most promising blocks first, and of the others only those whose bound reaches the
k-th score found. Postings lie by bucket of terms, term and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import small_batches, written
from ..functions.text import simple_lexemes

#: Documents of a block, folders that terms are dealt to, and blocks that each question scores first.
BLOCK_DOCS, BUCKETS, FIRST_BLOCKS = 1024, 64, 8
#: Questions that are sent to every task at once, and cells of a table of documents by questions.
QUESTIONS_PER_PASS, CELLS = 1 << 17, 1 << 21
#: Fixed value: what an occurrence counts, the weight of plain text.
WEIGHT = 0.1


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    """``postings``: bucket, term, block, id, tf, places; ``maxima``: bucket, term, block, most, docs; ``blocks``: how many there are."""

    postings: DataFrame
    maxima: DataFrame
    blocks: int

    def _of(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of a table that lie in the folders of the asked terms."""
        folders = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        return table.where(F.col("bucket").isin(folders))

    def hits(self, asked: DataFrame) -> DataFrame:
        """q, id, n (occurrences), d (terms that occur) for (q, bucket, term), and block where it is to be looked at."""
        key = ["bucket", "term"] + (["block"] if "block" in asked.columns else [])
        found = self._of(self.postings, asked).select(*key, "id", "tf").join(asked, key)
        return found.groupBy("q", "id").agg(F.sum("tf").alias("n"), F.count("*").alias("d"))

    def search(self, questions: DataFrame, k: int, query_col: str = "query_id", question_col: str = "pregunta", id_col: str = "legal_ref", tokens: Callable[[Column], Column] = simple_lexemes, distinct: bool = False, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """``query_col``, ``id_col``, score, rank: documents with any of the question's terms.

        The score is a tenth of the number of times that its distinct terms occur (of the terms
        that occur, with ``distinct``); ties go to the smaller id. A question without terms finds nothing.
        """
        asked = questions.select(F.col(query_col).alias("q"), F.explode(F.array_distinct(tokens(F.col(question_col)))).alias("term")).distinct().withColumn("bucket", _bucket("term"))
        asked, by = written(asked), "d" if distinct else "n"
        if self.blocks <= first_blocks:
            found = self.hits(asked)
        else:
            bounds = self._of(self.maxima, asked).join(asked, ["bucket", "term"]).groupBy("q", "block").agg((F.count("*") if distinct else F.sum("most")).alias("bound"))
            turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
            bounds = written(bounds.withColumn("turn", turn))
            found = written(self.hits(asked.join(bounds.where(F.col("turn") <= first_blocks).select("q", "block"), "q")))
            kth = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "id"))).where(F.col("r") == k).select("q", F.col(by).alias("kth"))
            more = bounds.where(F.col("turn") > first_blocks).join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("q", "block")
            found = found.unionByName(self.hits(asked.join(more, "q")))
        order = Window.partitionBy("q").orderBy(F.desc(by), F.col("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), (F.col(by) * F.lit(WEIGHT)).alias("score"), "rank")

    def covers(self, questions: DataFrame, query_col: str = "query_id", id_col: str = "legal_ref") -> DataFrame:
        """``query_col``, ``id_col``, score: documents that have all of a question's terms and phrases and none of what it excludes.

        ``questions`` have a column asked: (terms, phrases, excluded), as of ``web_query``.
        A cover is a window of places, as short as can be, with every term and phrase in it; the score adds up
        for each cover ``WEIGHT`` / (1 + places in it that hold none of the question's terms).
        A question without a term or phrase finds nothing. Ids are unique.
        """
        q = _units(questions, query_col)
        names = F.array_distinct(F.flatten("units"))
        asked = written(q.where(F.size("units") > 0).withColumn("names", names).select("q", "units", "excluded", "names", F.explode("names").alias("term")).withColumn("bucket", _bucket("term")))
        found = self._of(self.postings, asked).select("bucket", "term", "id", "places").join(asked.select("q", "bucket", "term"), ["bucket", "term"])
        places = found.groupBy("q", "id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("places"), F.count("*").alias("d"))  # an entry for each of the question's terms
        whole = q.withColumn("n", F.size(names)).select("q", "units", "n")
        rows = places.join(whole, "q").where("d = n").select("q", "id", F.transform("units", lambda u: F.transform(u, lambda t: F.try_element_at("places", t))).alias("found"))
        out = q.select("q", F.explode(F.array_distinct("excluded")).alias("term")).withColumn("bucket", _bucket("term"))
        gone = self._of(self.postings, out).select("bucket", "term", "id").join(out, ["bucket", "term"]).select("q", "id").distinct()
        scored = rows.join(gone, ["q", "id"], "left_anti").withColumn("score", cover_density("found")).where("score > 0")
        return scored.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score")

    def write(self, path: str, version: str, replace: bool = False) -> None:
        """Writes the index as that of a version, which must not be there without ``replace``. A term that many documents have is spread over files by block."""
        folder, mode = f"{path}/version={version}", "overwrite" if replace else "error"
        self.postings.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.mode(mode).partitionBy("bucket").parquet(f"{folder}/postings")
        self.maxima.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{folder}/maxima")
        self.postings.sparkSession.range(1).select(F.lit(self.blocks).alias("blocks")).write.mode(mode).parquet(f"{folder}/size")  # last: what is complete has it

    @staticmethod
    def read(spark: SparkSession, path: str, version: str) -> TextIndex:
        folder = f"{path}/version={version}"
        return TextIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/maxima"), spark.read.parquet(f"{folder}/size").first().blocks)


def _units(questions: DataFrame, query_col: str) -> DataFrame:
    """q, units (each a term or the words of a phrase), excluded, and what else ``asked`` has."""
    q = questions.select(F.col(query_col).alias("q"), "asked.*")
    return q.withColumn("units", F.concat(F.transform(F.array_distinct("terms"), lambda t: F.array(t)), F.col("phrases")))


def scan_covers(questions: DataFrame, docs: DataFrame, query_col: str = "query_id", id_col: str = "legal_ref", text_col: str = "content", tokens: Callable[[Column], Column] = simple_lexemes) -> DataFrame:
    """What ``covers`` of an index of ``docs`` gives, without one: each document is judged in the task that reads it, and nothing is shuffled.

    For questions that are asked once. Rows of one id are one document, found by an index of these.
    """
    once, again = parted(docs, id_col)
    asked = written(_units(questions, query_col).where(F.size("units") > 0).select("q", "units", F.array_distinct("excluded").alias("excluded")))
    words = small_batches(once).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    passes, found = max(1, -(-asked.count() // QUESTIONS_PER_PASS)), None
    for p in range(passes):
        one = _covers_of(asked if passes == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p), words)
        found = one if found is None else found.unionByName(one)
    found = found.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score")
    return found if again is None else found.unionByName(build(again, id_col, text_col, tokens).covers(questions, query_col, id_col))


def _covers_of(asked: DataFrame, words: DataFrame) -> DataFrame:
    """q, id, score of the documents (id, words) that have all of a question's units and nothing that it excludes."""
    rows = asked.toArrow()  # QUESTIONS_PER_PASS or so
    units, excluded = rows.column("units").to_pylist(), rows.column("excluded").to_pylist()
    number: dict[str, int] = {}
    coded = [[[number.setdefault(t, len(number)) for t in unit] for unit in u] for u in units]
    out = [[number.setdefault(t, len(number)) for t in e or ()] for e in excluded]
    needed = [{t for unit in u for t in unit} for u in coded]
    # The questions that ask for a term; one that excludes it can't reach its number of terms.
    pairs = sorted([(t, i, 1) for i, ts in enumerate(needed) for t in ts] + [(t, i, -len(needed[i]) - 1) for i, ts in enumerate(out) for t in ts])
    term, of, counts = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ((), (), ())))
    begin = np.searchsorted(term, np.arange(len(number) + 1))
    shared = words.sparkSession.sparkContext.broadcast((rows.column("q").combine_chunks(), pa.array(list(number), pa.string()), coded, np.array([len(n) for n in needed], np.int64), begin, of, counts))
    q_kind, id_kind = asked.schema["q"].dataType, words.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, coded, needed, begin, of, counts = shared.value
        step = max(1, CELLS // max(1, len(names)))
        for b in batches:
            for first in range(0, len(b) if len(names) else 0, step):
                lists = b.column(1).slice(first, step)
                code = pc.index_in(lists.flatten(), value_set=known)
                doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                there = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                key = doc[there] * len(known) + code.take(pa.array(there)).to_numpy()
                order = np.argsort(key, kind="stable")
                keys, times = np.unique(key, return_counts=True)
                place, ends = place[there][order], np.cumsum(times)
                at, m = begin[keys % len(known)], np.diff(begin)[keys % len(known)]
                entry = np.arange(int(m.sum())) + np.repeat(at - (np.cumsum(m) - m), m)
                cell = np.repeat(keys // len(known), m) * len(names) + of[entry]
                n = np.bincount(cell, counts[entry], len(lists) * len(names)).reshape(len(lists), len(names))
                docs, asked_ = np.nonzero(n == needed)
                spot = dict(zip(keys.tolist(), range(len(keys))))

                def places(d: int, t: int) -> list[int]:
                    i = spot[d * len(known) + t]
                    return place[ends[i] - times[i] : ends[i]].tolist()

                score = np.array([density([[places(d, t) for t in unit] for unit in coded[i]]) for d, i in zip(docs.tolist(), asked_.tolist())], float)
                good = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(asked_[good])), b.column(0).slice(first, step).take(pa.array(docs[good])), pa.array(score[good])], names=["q", "id", "score"])

    return words.mapInArrow(run, f"q {q_kind.simpleString()}, id {id_kind.simpleString()}, score double")


def build(docs: DataFrame, id_col: str = "legal_ref", text_col: str = "content", tokens: Callable[[Column], Column] = simple_lexemes) -> TextIndex:
    """The index of all documents. Null texts have no terms; rows of one id are one document, whose places are those of all."""
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("place", "term"))
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    postings = words.groupBy("term", "id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    postings = postings.select(_bucket("term").alias("bucket"), "term", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", F.size("places").alias("tf"), "places")
    postings = written(postings)
    return TextIndex(postings, postings.groupBy("bucket", "term", "block").agg(F.max("tf").alias("most"), F.count("*").alias("docs")), blocks)


def parted(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id stands once, and those of repeated ids, if there are any. Null is an id."""
    repeated = docs.groupBy(F.col(id_col).alias("_repeated")).agg(F.count("*").alias("n")).where("n > 1").select("_repeated")
    if repeated.isEmpty():
        return docs, None
    repeated = written(repeated)
    same = F.col(id_col).eqNullSafe(F.col("_repeated"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def stored(spark: SparkSession, folder: str, version: str, docs: Callable[[], DataFrame], **how) -> TextIndex:
    """The index of a version from ``folder``; it is built and written if it isn't there, or not to its end."""
    try:
        return TextIndex.read(spark, folder, version)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build(docs(), **how).write(folder, version, replace=True)
    return TextIndex.read(spark, folder, version)


def web_query(text: Column, tokens: Callable[[Column], Column] = simple_lexemes) -> Column:
    """(terms, phrases, excluded) of a question as people write it: words, "phrases in quotes", and -words or -"phrases" that must not be there.

    Of an excluded phrase every word is excluded; a phrase of one word is a term.
    """
    quoted = F.regexp_extract_all(text, F.lit(r'(?<!-)"([^"]*)"'), F.lit(1))
    without = F.regexp_replace(text, r'-?"[^"]*"', " ")
    minus = F.concat(F.regexp_extract_all(text, F.lit(r'-"([^"]*)"'), F.lit(1)), F.regexp_extract_all(without, F.lit(r"(?<!\S)-(\S+)"), F.lit(1)))
    plain = F.regexp_replace(without, r"(?<!\S)-\S+", " ")
    phrases = F.transform(quoted, tokens)
    terms = F.concat(tokens(plain), F.flatten(F.filter(phrases, lambda p: F.size(p) == 1)))
    return F.struct(terms.alias("terms"), F.filter(phrases, lambda p: F.size(p) > 1).alias("phrases"), F.flatten(F.transform(minus, tokens)).alias("excluded"))


def density(units: list[list[list[int]]]) -> float:
    """The sum over all covers of ``units``, each given by the places of its words, in order."""
    places = sorted({p for unit in units for word in unit for p in word})
    number = {p: i for i, p in enumerate(places)}
    ends: dict[int, list[tuple[int, int]]] = {}
    for u, unit in enumerate(units):
        starts = set(unit[0])
        for k, word in enumerate(unit[1:], 1):
            starts &= {p - k for p in word}
        for s in starts:
            ends.setdefault(number[s + len(unit) - 1], []).append((u, number[s]))
    last, begun, total = [-1] * len(units), -1, 0.0
    for i in sorted(ends):
        for u, start in ends[i]:
            last[u] = max(last[u], start)
        begin = min(last)
        if begin > begun:  # the first window that begins there is the shortest
            begun = begin
            total += WEIGHT / (1 + (places[i] - places[begin]) - (i - begin))
    return total


@F.arrow_udf(T.DoubleType())
def cover_density(units: pa.Array) -> pa.Array:
    """``density`` of each row's units."""
    return pa.array([density(row) for row in units.to_pylist()], pa.float64())
