"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text. N-gram counts are summed by key over all
training shards, and joins of the count tables on their contexts and suffixes
give each n-gram's probability and each context's back-off weight; these tables
stay sharded by key.

Documents are dealt into blocks. Each block's different n-grams are joined with
the sharded tables, level by level, and what they cost comes back to the block,
where the documents add it up. So a frequent n-gram is looked up once a block and
not once a document, and no table is sent to every task.

A document's perplexity is compared with a quantile over the trusted documents of
its language and length (short texts scatter more than long ones).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, released

#: Characters of an n-gram, and bits of a character's number, so that n-grams are 64-bit integers.
ORDER, BITS = 4, 16
START, OTHER = 0, 1
#: Characters with a number of their own, the most frequent ones of the training text; more don't fit ``BITS``.
MAX_CHARACTERS = (1 << BITS) - 2
#: Ids of training documents that are sent to every task; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
QUANTILE = 0.998
#: Languages with fewer trusted documents use the thresholds of all languages; a threshold rests on as many at least.
LEAST_TRUSTED = 50
#: Characters of a block of documents.
BLOCK_CHARACTERS = 32_000_000
#: Lengths are classed by powers of two, up to this one; a class is judged with so many next ones on both sides.
LONGEST = 31
NEXT = 2
MAX_BROADCAST_THRESHOLDS = 100_000

#: Runs that hold digits and letters like keys do count as one unknown character, with their quotes and the assignment before them:
#: secrets are another operator's matter.
KEY = re.compile(r"(?=[A-Za-z_+/=\-]*[0-9])(?=[0-9_+/=\-]*[A-Za-z])[A-Za-z0-9_+/=\-]{16,}[\"'`]?")
ASSIGNED = re.compile(r"(?:\s{0,3}[=:]\s{0,3})?[\"'`]?\Z")
KEY_MARK = "\ue000"
DIGITS = np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"])


def masked(text: str) -> str:
    """``text`` with a mark for each key."""
    out, at = [], 0
    for m in KEY.finditer(text):
        s = max(at, m.start() - 8)
        out += [text[at:s], ASSIGNED.sub("", text[s : m.start()], count=1), KEY_MARK]
        at = m.end()
    return "".join(out) + text[at:] if at else text


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of ``texts``, end to end, with keys as marks, and each text's number of them."""
    marked = [masked(t) for t in texts]
    return np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.array([len(t) for t in marked], dtype=np.int64)


def _grams(texts: Sequence[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each character of each text, end to end, and each text's number of them."""
    points, sizes = _points(texts)
    pad = ORDER - 1
    z = np.zeros(len(points) + pad * len(sizes), dtype=np.int64)  # START before each text
    z[np.arange(len(points)) + pad * (np.repeat(np.arange(len(sizes)), sizes) + 1)] = numbers[points]
    g = z[: len(z) - pad].copy() if len(z) else z
    for k in range(1, ORDER):
        g = g << BITS | z[k : len(z) - pad + k]
    return g[z[pad:] != START] if len(z) else g, sizes


def _parts(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters, each list with the place of its first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def _suffix(g: Column, k: int) -> Column:
    """The last ``k`` characters of an n-gram."""
    return g if k == ORDER else g.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context(g: Column, k: int) -> Column:
    """What stands before the last of the last ``k`` characters."""
    return F.shiftrightunsigned(_suffix(g, k), BITS)


def _discounts(counts: DataFrame) -> DataFrame:
    """One row d1, d2, d3: the modified Kneser-Ney discounts for counts 1, 2 and 3 or more; 0.75 times min(i, 2) where counts of counts are missing."""
    t = counts.agg(*[F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(i: int):
        value = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.when((value > 0) & (value < i), value).otherwise(0.75 * min(i, 2) if i > 1 else 0.75).alias(f"d{i}")

    return t.select(d(1), d(2), d(3))


class KneserNey:
    """``numbers``: each character's number; ``p[k]``: (g, p) of the k-grams; ``w[k]``: (g, w), the back-off weights of their contexts."""

    def __init__(self, numbers: np.ndarray, p: dict[int, DataFrame], w: dict[int, DataFrame], unknown: float) -> None:
        self.numbers, self.p, self.w, self.unknown = numbers, p, w, unknown

    def cost(self, grams: DataFrame) -> DataFrame:
        """g and cost (bits) of different n-grams ``g``: the longest part that the tables hold, times the weights above it."""
        out = grams.select("g", F.lit(self.unknown).alias("_p"))

        def joined(df: DataFrame, table: DataFrame, key: Column, name: str, value: Column) -> DataFrame:
            own = table.select(F.col("g").alias("_k"), F.col(name).alias("_v"))
            return df.withColumn("_k", key).join(own, "_k", "left").select("g", value.alias("_p"))

        g = F.col("g")
        for k in range(1, ORDER + 1):
            if k > 1:
                out = joined(out, self.w[k], _context(g, k), "w", F.coalesce("_v", F.lit(1.0)) * F.col("_p"))
            out = joined(out, self.p[k], _suffix(g, k), "p", F.coalesce("_v", "_p"))
        return out.select("g", (-F.log2("_p")).alias("cost"))


def train_kneser_ney(texts: DataFrame, text_col: str = "text") -> KneserNey | None:
    """A model of all non-empty texts, or None if there are none. They are read twice: for their characters, then for their n-grams."""
    texts = texts.select(F.col(text_col).cast("string").alias("t")).where("length(t) > 0")

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            for _, part in _parts(b.column(0).to_pylist()):
                total += np.bincount(_points(part)[0], minlength=0x110000)
        total[0x30] = total[DIGITS].sum()
        total[DIGITS[DIGITS != 0x30]] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["c", "n"])

    common = texts.mapInArrow(characters, "c int, n bigint").where(F.col("c") != ord(KEY_MARK)).groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(MAX_CHARACTERS).collect()
    if not common:
        return None
    numbers = np.full(0x110000, OTHER, dtype=np.uint16)
    for i, row in enumerate(common):
        numbers[row.c] = i + 2
    numbers[DIGITS] = numbers[0x30]
    shared = texts.sparkSession.sparkContext.broadcast(numbers)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _parts(b.column(0).to_pylist()):
                found = pc.value_counts(pa.array(_grams(part, shared.value)[0]))
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["g", "n"])

    g = F.col("g")
    counts = {ORDER: cut(texts.mapInArrow(counted, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters come before
        counts[k] = cut(counts[k + 1].groupBy(_suffix(g, k).alias("g")).agg(F.count("*").alias("n")))
    total = counts[1].agg(F.sum("n")).first()[0]
    base = total + 0.5 * (len(common) + 1)  # the unigram level keeps half a count for each character and for all others
    p, w = {1: counts[1].select("g", ((F.col("n") + 0.5) / base).alias("p"))}, {}
    for k in range(2, ORDER + 1):
        d = _discounts(counts[k])  # one row
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = counts[k].crossJoin(F.broadcast(d)).select("g", "n", less.alias("less"), _context(g, k).alias("context"), _suffix(g, k - 1).alias("suffix"))
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("w"))
        lower = p[k - 1].select(F.col("g").alias("suffix"), F.col("p").alias("p_low"))
        p[k] = cut(level.join(sums, "context").join(lower, "suffix").select("g", ((F.col("n") - F.col("less")) / F.col("total") + F.col("w") * F.col("p_low")).alias("p")))
        w[k] = cut(sums.select(F.col("context").alias("g"), "w"))
    return KneserNey(numbers, p, w, 0.5 / base)


def _distinct(batches: Iterator[pa.RecordBatch], numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, text), sorted by block, to each block's different n-grams."""
    held: list[np.ndarray] = []
    size, block = 0, None

    def found() -> pa.RecordBatch:
        grams = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block), pa.int32()), pa.array(grams)], names=["block", "g"])

    for b in batches:
        blocks = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            if held and blocks[s] != block:
                yield found()
                held, size = [], 0
            block = int(blocks[s])
            for _, part in _parts(b.column(1).slice(s, e - s).to_pylist()):
                held.append(pc.unique(pa.array(_grams(part, numbers)[0])).to_numpy())
                size += len(held[-1])
                if size > 8_000_000:  # new ones since the last time
                    held, size = [np.unique(np.concatenate(held))], 0
    if held:
        yield found()


def _added(batches: Iterator[pa.RecordBatch], numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, kind, g, cost, t, rest), sorted: a block's costs (kind 0) before its documents (kind 1); to (bits, chars, rest)."""
    block, keys, costs, table = None, [], [], None
    for b in batches:
        at = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        edges = [0, *(np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1).tolist(), at.shape[1]]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            if at[0, s] != block:
                block, keys, costs, table = at[0, s], [], [], None
            part = b.slice(s, e - s)
            if at[1, s] == 0:
                keys.append(part.column(2))
                costs.append(part.column(3).to_numpy())
                continue
            if table is None:
                order = np.argsort(k := pa.chunked_array(keys, pa.int64()).to_numpy())
                table = k[order], np.concatenate([*costs, np.empty(0)])[order]
            bits, chars = [], []
            for _, texts in _parts([t or "" for t in part.column(4).to_pylist()]):
                grams, sizes = _grams(texts, numbers)
                cost = np.zeros(len(grams) + 1)
                # Different n-grams are few: only they are looked for in the table.
                if len(grams):
                    coded = pa.array(grams).dictionary_encode()
                    asked = coded.dictionary.to_numpy()
                    at_key = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
                    if not len(table[0]) or (table[0][at_key] != asked).any():
                        raise RuntimeError("the documents are not those that were counted before")
                    cost[:-1] = table[1][at_key][coded.indices.to_numpy()]
                starts = np.cumsum(sizes) - sizes
                total = np.add.reduceat(cost, starts)
                bits += [float(x) if n else None for x, n in zip(total, sizes)]
                chars += sizes.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.float64()), pa.array(chars, pa.int64()), part.column(5)], names=["bits", "chars", "rest"])


def with_bits(docs: DataFrame, model: KneserNey | None, columns: Sequence[str] | None = None, text_col: str = "text", id_col: str = "doc_id", name: str = "bits_per_char", block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """``columns`` of ``docs`` (or all), each whole text's bits a character, and ``_chars``; null without a model and for a null or empty text.

    Characters are counted with keys as one. Rows are dealt by the hash of id and
    text, so only rows that are equal in both must share a block; a block's
    documents are streamed, its different n-grams are held.
    """
    columns = list(docs.columns if columns is None else columns)
    if model is None:
        return docs.select(*columns, F.lit(None).cast("double").alias(name), F.lit(None).cast("bigint").alias("_chars"))
    text = F.col(text_col).cast("string")
    shared = docs.sparkSession.sparkContext.broadcast(model.numbers)
    total = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(-(-total // block_characters) or 1)).cast("int").alias("block")
    dealt = docs.select(block, text.alias("t"), F.struct(*columns).alias("rest"))
    texts = dealt.where("length(t) > 0").select("block", "t").repartition("block").sortWithinPartitions("block")
    pairs = cut(texts.mapInArrow(released(lambda b: _distinct(b, shared.value)), "block int, g bigint"))
    cost = cut(model.cost(pairs.select("g").distinct()))
    nothing = lambda c: F.lit(None).cast(dealt.schema[c].dataType).alias(c)
    costs = pairs.join(cost, "g").select("block", F.lit(0).alias("kind"), "g", "cost", nothing("t"), nothing("rest"))
    rows = dealt.select("block", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("double").alias("cost"), "t", "rest")
    together = costs.unionByName(rows).repartition("block").sortWithinPartitions("block", "kind")
    fields = T.StructType([T.StructField("bits", T.DoubleType()), T.StructField("chars", T.LongType()), T.StructField("rest", dealt.schema["rest"].dataType)])
    found = together.mapInArrow(released(lambda b: _added(b, shared.value)), fields)
    return found.select(*[F.col("rest").getField(c).alias(c) for c in columns], (F.col("bits") / F.col("chars")).alias(name), F.col("chars").alias("_chars"))


def _length_class(chars: Column) -> Column:
    return F.least(F.floor(F.log2(chars)).cast("int"), F.lit(LONGEST))


def thresholds(trusted: DataFrame, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> DataFrame:
    """lang, size, threshold from (lang, bits, chars): for each language with enough rows (and for null, all together) and each class of lengths.

    The threshold is the smallest value that at least a ``quantile`` of the
    language's rows of that class and ``NEXT`` ones on both sides don't exceed.
    Where those have fewer than ``least`` rows, further ones count too, until there
    are as many. Values are rounded to 0.001, so what is held is bounded.
    """
    lang = F.explode(F.when(F.col("lang").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array("lang", F.lit(None).cast("string")))).alias("lang")
    hist = cut(trusted.select(lang, _length_class(F.col("chars")).alias("size"), F.round("bits", 3).alias("bits")).groupBy("lang", "size", "bits").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("lang", "size").agg(F.sum("n").alias("n"))
    # For each class of lengths the classes that are needed; at most (LONGEST + 1) ** 2 rows a language.
    near = sizes.withColumn("for", F.explode(F.sequence(F.lit(0), F.lit(LONGEST)))).withColumn("off", F.abs(F.col("size") - F.col("for")))
    inside = Window.partitionBy("lang", "for").orderBy("off").rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang", "for")
    near = near.withColumns({"closer": F.coalesce(F.sum("n").over(inside), F.lit(0)), "all": F.sum("n").over(whole)})
    near = near.where(((F.col("off") <= NEXT) | (F.col("closer") < least)) & (F.col("lang").isNull() | (F.col("all") >= least))).select(F.col("lang").alias("_l"), F.col("size").alias("_s"), "for")
    rows = hist.join(near, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("size") == F.col("_s"))).groupBy("lang", "for", "bits").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "for")
    ranked = rows.withColumns({"below": F.sum("n").over(group.orderBy("bits")), "all": F.sum("n").over(group)})
    return cut(ranked.where(F.col("below") >= quantile * F.col("all")).groupBy("lang", F.col("for").alias("size")).agg(F.min("bits").alias("threshold")))


def quality_classifier(docs: DataFrame, labels: DataFrame, columns: Sequence[str] | None = None, quantile: float = QUANTILE, block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """All rows of ``docs`` (doc_id, lang, text, others), with bits_per_char, perplexity, threshold (in bits a character) and kept.

    ``columns`` of ``docs`` are returned, or all. Trusted are the documents with a
    label of quality 1 (and none of 0). The half of them with even hashes of their ids
    trains the model, and all of the other half give the thresholds, by language and
    length: a text that a model is trained on says nothing of what it makes of others. Fewer than twice ``LEAST_TRUSTED`` serve both ends.

    A text is kept if its perplexity is at most its threshold. A null or empty
    text has no perplexity and is kept, as is everything where nothing is trusted
    (no labels, or none that match a document). A null, unknown or rare language
    is judged by all languages' thresholds. Digits count as one character, and so
    does a run that looks like a key. Repeated rows each get theirs. Columns of
    ``docs`` with the names of results are replaced.
    """
    results = ["bits_per_char", "perplexity", "threshold", "kept", "_chars"]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in results]
    docs = docs.drop(*results)
    sure = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    number = F.xxhash64("doc_id")
    trains = F.lit(True) if (all_serve := sure.count() < 2 * LEAST_TRUSTED) else number % 2 == 0
    own = cut(sure.where(trains))
    few = own.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    model = train_kneser_ney(docs.select("doc_id", "text").join(F.broadcast(own) if few else own, "doc_id", "left_semi"))
    scored = cut(with_bits(docs, model, columns, block_characters=block_characters))
    trusted = scored.join(sure if all_serve else sure.where(~trains), "doc_id", "left_semi").where("bits_per_char is not null")
    found = thresholds(trusted.select("lang", F.col("bits_per_char").alias("bits"), F.col("_chars").alias("chars")), quantile)

    own = found.where("lang is not null").select(F.col("lang").alias("_l"), F.col("size").alias("_s"), F.col("threshold").alias("_t"))
    rest = found.where("lang is null").select(F.col("size").alias("_s0"), F.col("threshold").alias("_t0"))
    # ``rest`` has LONGEST + 1 rows at most; ``own`` is sent to the tasks if it is known to be small, else joined by shuffle.
    few = own.limit(MAX_BROADCAST_THRESHOLDS + 1).count() <= MAX_BROADCAST_THRESHOLDS
    judged = scored.withColumn("_size", _length_class(F.col("_chars")))
    judged = judged.join(F.broadcast(own) if few else own, (F.col("lang") == F.col("_l")) & (F.col("_size") == F.col("_s")), "left").join(F.broadcast(rest), F.col("_size") == F.col("_s0"), "left")
    limit = F.coalesce("_t", "_t0")
    return judged.select(*columns, "bits_per_char", F.pow(F.lit(2.0), F.col("bits_per_char")).alias("perplexity"), limit.alias("threshold"), F.coalesce(F.round("bits_per_char", 3) <= limit, F.lit(True)).alias("kept"))
