"""Language-model scoring by a hashed maximum-entropy model of words.

A word's probability is class-factored: that of its group given the words before
it, that of its leaf within the group given the same, and that of the word within
its leaf by how often it occurs. The commonest words have a leaf each, the others
share leaves by their endings; leaves that stand in like surroundings make a group. The two
softmaxes are log-linear in the previous word, the word before that (a skip
feature) and both together, each hashed to a row of weights; a row of the second
softmax belongs to a feature and a group.

The weights are trained on all training tokens by distributed gradient updates.
Every task counts what it observes, or what the model expects, for its tokens;
Spark adds these up row by row, and the gradient, observed minus expected, moves
each weight, divided by the logarithmic mean of the two: log(observed / expected).
Before any update the model expects the leaves' shares, so the first gradient
needs counts only.

Texts are tokenised once into blocks of whole documents, which are written. A
block's different words meet the corpus' counts in a join, so that no task holds
the vocabulary; the weights are bounded in size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, small_batches, word_hashes

#: Bytes of text in a block, at least, unless there are no more; a document is never parted.
BLOCK_BYTES = 8 << 20
#: Words with a leaf of their own, and leaves that the others share by the last ``ENDING`` bytes.
COMMON, SHARED, ENDING = 256, 256, 3
GROUPS = 16
LEAVES = COMMON + SHARED
IN_GROUP = LEAVES // GROUPS
#: Rows of weights, as powers of two: previous word, the one before, both.
BITS = (14, 14, 15)
ROWS = sum(1 << b for b in BITS)
STARTS = np.cumsum([0] + [1 << b for b in BITS])[:-1]
#: Tokens that meet the weights at once.
AT_ONCE = 1 << 13
#: What stands before a document's first word.
BEGIN = np.uint64(0x5BD1E9955BD1E995)
#: Pseudo-counts of a leaf's share in every row, and how far the updates go. Three features are active at a time.
PRIOR, STEPS = 50.0, (0.5, 0.5)


# Tokenising


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked_array(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def encoded_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: block, ids, train, lens, and compressed tokens, words and counts (of the words in training documents).

    ``docs`` has a boolean column train. A token is the number of a word of the
    block, the commonest being 0. Every document ends with the end, which is written as a word of no bytes.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held, size = TaskContext.get().partitionId() << 33, 0, [], 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy()
            start = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= BLOCK_BYTES:
                    yield _encoded([*held, b.slice(start, i + 1 - start)], first + k)
                    k, held, size, start = k + 1, [], 0, i + 1
            if start < len(b):
                held.append(b.slice(start))
        if held:
            yield _encoded(held, first + k)
        give_back()

    schema = f"block bigint, ids array<{kind.simpleString()}>, train array<boolean>, lens array<int>, tokens binary, n_words int, n_bytes bigint, word_lens binary, words binary, counts binary"
    return docs.select(F.col(id_col).alias("id"), "train", F.col(text_col).alias("text")).mapInArrow(run, schema)


def _encoded(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    texts = pc.fill_null(table.column("text"), "").combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), np.cumsum(split.value_lengths().to_numpy())
    word = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(word)])[ends]
    coded = flat.filter(pa.array(word)).dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
    # Each document's words, then the end.
    lens = np.diff(before, prepend=0) + 1
    train = table.column("train").to_numpy()
    tokens = np.full(int(lens.sum()), len(words) - 1, np.int64)
    place = np.ones(len(tokens), bool)
    place[np.cumsum(lens) - 1] = False
    tokens[place] = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words))
    tokens, words = number[tokens], words.take(pa.array(order))
    counts = np.bincount(tokens[np.repeat(train, lens)], minlength=len(words)).astype(np.int32)
    sizes = pc.binary_length(words).to_numpy().astype(np.uint32)
    one = lambda x, kind: pa.array([x], kind)
    raw = b"".join(words.to_pylist())
    return pa.RecordBatch.from_arrays(
        [one(block, pa.int64()), one(table.column("id").to_pylist(), pa.list_(table.schema.field("id").type)), one(train, pa.list_(pa.bool_())), one(lens, pa.list_(pa.int32())), one(_packed(tokens), pa.binary()), one(len(words), pa.int32()), one(len(raw), pa.int64()), one(_packed(sizes), pa.binary()), one(_packed(np.frombuffer(raw, np.uint8)), pa.binary()), one(_packed(counts), pa.binary())],
        names=["block", "ids", "train", "lens", "tokens", "n_words", "n_bytes", "word_lens", "words", "counts"],
    )


def _words(row) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block's words, one after another, and where each begins, with the end of the last."""
    n_words, n_bytes = row("n_words"), row("n_bytes")
    return _unpacked_array(row("words"), n_bytes, np.uint8), np.concatenate([[0], np.cumsum(_unpacked_array(row("word_lens"), n_words, np.uint32).astype(np.int64))])


def word_rows(encoded: DataFrame) -> DataFrame:
    """block, place, word, n: each block's words, how often they stand in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = lambda c, b=b, i=i: b.column(c)[i].as_py()
                raw, at = _words(row)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).cast(pa.binary())
                counts = _unpacked_array(row("counts"), len(words), np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row("block"))), pa.array(np.arange(len(words), dtype=np.int32)), words, pa.array(counts)], names=["block", "place", "word", "n"])

    return encoded.select("block", "n_words", "n_bytes", "word_lens", "words", "counts").mapInArrow(run, "block bigint, place int, word binary, n bigint")


# Counts


def common_words(counts: DataFrame) -> list[bytes]:
    """The words with a leaf of their own: the commonest, of equal counts the smaller first."""
    return [bytes(r.word) for r in counts.where("c > 0").orderBy(F.desc("c"), "word").limit(COMMON).collect()]


def leaf_of(words: pa.Array, raw: np.ndarray, at: np.ndarray, common: list[bytes]) -> np.ndarray:
    """Each word's leaf: its own, or one by its last bytes. ``raw`` and ``at``: the words' bytes, and where each begins."""
    own = pc.index_in(words, value_set=pa.array(common, words.type)).fill_null(-1).to_numpy()
    ending = np.zeros(len(words), np.uint64)
    for k in range(1, ENDING + 1):
        there = np.flatnonzero(np.diff(at) >= k)
        ending[there] = ending[there] * np.uint64(256) + raw[at[there + 1] - k] + np.uint64(1)
    return np.where(own >= 0, own, COMMON + (mix64(ending) % np.uint64(SHARED)).astype(np.int64))


class Leaves:
    """How the training words of each leaf share its probability."""

    def __init__(self, counts: DataFrame) -> None:
        self.common = common = common_words(counts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((4, LEAVES), np.int64)
            for b in batches:
                words, c = b.column(0).cast(pa.large_binary()), b.column(1).to_numpy()
                at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
                leaf = leaf_of(words, np.frombuffer(words.buffers()[2] or b"", np.uint8), at, common)
                for k, x in enumerate((c, c > 0, c == 1, c == 2)):
                    sums[k] += np.bincount(leaf, weights=x, minlength=LEAVES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEAVES, dtype=np.int32)), *map(pa.array, sums)], names=["leaf", "n", "v", "once", "twice"])

        known = counts.where("c > 0").select("word", "c").mapInArrow(run, "leaf int, n bigint, v bigint, once bigint, twice bigint")
        self.n, self.v, self.cut = np.zeros(LEAVES), np.zeros(LEAVES), np.zeros(LEAVES)
        for r in known.groupBy("leaf").agg(*[F.sum(x).alias(x) for x in ("n", "v", "once", "twice")]).collect():
            self.n[r.leaf], self.v[r.leaf] = r.n, r.v
            # What each word gives to those that training has not seen, by Good and Turing; a common word has no such neighbours.
            self.cut[r.leaf] = 0 if r.leaf < COMMON else min(max(r.once / max(1, r.once + 2 * r.twice), 0.05), 0.95)
        self.train_tokens, self.words = int(self.n.sum()), int(self.v.sum())

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.train_tokens + 0.5 * (self.words + 1)))

    def inner(self, c: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log10 of the word's share in its leaf; all words without a count are one word there."""
        n, unseen = self.n[leaf], np.where(self.n[leaf] > 0, self.cut[leaf] * self.v[leaf], 1)
        return np.log10(np.where(c > 0, c - self.cut[leaf], unseen) / np.where(n > 0, n, 1))


def counted_blocks(encoded: DataFrame, rows: DataFrame, counts: DataFrame, leaves: Leaves) -> DataFrame:
    """Blocks with what the counts say of their words: block, ids, train, lens, tokens, n_words, leaf, hashes and, for each document, base, inner, known.

    Only words of several blocks are brought back to them; of the others a block has the count itself.
    """
    found = rows.select(F.col("block").alias("of"), "place", "word").join(counts.where("blocks > 1").select("word", "c"), "word").select("of", "place", "c")
    ids = encoded.schema["ids"].dataType

    def run(key, words: pa.Table, blocks: pa.Table) -> pa.Table:
        row = lambda c: blocks.column(c)[0].as_py()
        n_words = row("n_words")
        c = _unpacked_array(row("counts"), n_words, np.int32).astype(np.int64)
        c[words.column("place").to_numpy()] = words.column("c").to_numpy()
        raw, at = _words(row)
        leaf = leaf_of(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(at), pa.py_buffer(raw)]), raw, at, leaves.common)
        hashes = np.full(n_words, mix64(np.array([1], np.uint64))[0])  # the end's
        there = np.diff(at) > 0
        hashes[there] = word_hashes(raw.tobytes(), at[:-1][there], at[1:][there])
        tokens, lens = _unpacked_array(row("tokens"), int(sum(row("lens"))), np.uint32), blocks.column("lens").combine_chunks().flatten().to_numpy()
        begin = np.cumsum(lens) - lens
        each = lambda x: pa.array([np.add.reduceat(x[tokens], begin)])
        columns = [blocks.column(x) for x in ("block", "ids", "train", "lens", "tokens", "n_words")]
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        return pa.table([*columns, pa.array([leaf.astype(np.uint16).tobytes()]), pa.array([short.tobytes()]), each(leaves.base(c)), each(leaves.inner(c, leaf)), each((c > 0).astype(np.int64))], names=["block", "ids", "train", "lens", "tokens", "n_words", "leaf", "hashes", "base", "inner", "known"])

    schema = f"block bigint, ids {ids.simpleString()}, train array<boolean>, lens array<int>, tokens binary, n_words int, leaf binary, hashes binary, base array<double>, inner array<double>, known array<bigint>"
    return found.groupBy("of").cogroup(encoded.groupBy("block")).applyInArrow(run, schema)


# Weights


class Weights:
    """Two tables of weights, and which group and which place in it each leaf has."""

    def __init__(self, groups: np.ndarray, shares: np.ndarray) -> None:
        """``groups``: each leaf's group, all of one size; ``shares``: the leaves' training tokens."""
        self.group = groups
        order = np.argsort(groups, kind="stable")
        self.place = np.empty(LEAVES, np.int64)
        self.place[order] = np.arange(LEAVES) % IN_GROUP
        shares = shares + 0.5
        by_leaf = shares[order].reshape(GROUPS, IN_GROUP)
        by_group = by_leaf.sum(axis=1)
        self.group_share, self.leaf_share = by_group / by_group.sum(), by_leaf / by_group[:, None]
        self.first, self.second = np.zeros((ROWS, GROUPS), np.float32), np.zeros((ROWS, IN_GROUP), np.float32)
        self.bias = np.log(self.group_share).astype(np.float32), np.log(self.leaf_share).astype(np.float32)

    def odds(self, rows: list[np.ndarray], inner_rows: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the groups, and of the leaves of ``group``, up to a factor for each token.

        Weights are sums of logarithms of ratios of counts, far from where exponentials leave 32 bits.
        The results are viewed as this process' own type of numbers: in a worker the weights' is an
        equal one that was sent along, for which ``add.at`` is slow.
        """
        first, second = np.take(self.first, rows[0], axis=0), np.take(self.second, inner_rows[0], axis=0)
        for r, q in zip(rows[1:], inner_rows[1:]):
            first += np.take(self.first, r, axis=0)
            second += np.take(self.second, q, axis=0)
        first += self.bias[0]
        second += np.take(self.bias[1], group, axis=0)
        return np.exp(first, out=first).view(np.float32), np.exp(second, out=second).view(np.float32)


def features(tokens: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The row of each feature for each token."""
    word, begin = hashes[tokens].astype(np.uint64), np.cumsum(lens) - lens
    before = np.concatenate([[BEGIN], word[:-1]])
    before[begin] = BEGIN
    skip = np.concatenate([[BEGIN], before[:-1]])
    skip[begin] = BEGIN
    keys = (before, skip, before * np.uint64(0x9E3779B97F4A7C15) + skip)
    return [(mix64(x + np.uint64(i)) >> np.uint64(64 - b)).astype(np.int64) + s for i, (x, b, s) in enumerate(zip(keys, BITS, STARTS))]


def inner_features(rows: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """The rows of the second softmax: coarser hashes, with the group as their last bits."""
    return [(r - s) // GROUPS * GROUPS + group + s for r, s in zip(rows, STARTS)]


def _unpacked(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: batch, row, tokens, lens, leaves of words, hashes of words; of training documents alone, if asked."""
    for b in batches:
        for i in range(len(b)):
            leaf = np.frombuffer(b.column("leaf")[i].as_py(), np.uint16).astype(np.int64)
            hashes = np.frombuffer(b.column("hashes")[i].as_py(), np.uint32)
            lens = b.column("lens")[i].values.to_numpy()
            tokens = _unpacked_array(b.column("tokens")[i].as_py(), int(lens.sum()), np.uint32)
            if training:
                train = b.column("train")[i].values.to_numpy(zero_copy_only=False)
                tokens, lens = tokens[np.repeat(train, lens)], lens[train]
            if len(lens):
                yield b, i, tokens, lens, leaf, hashes


def _summed(blocks: DataFrame, width: int, add) -> dict[int, np.ndarray]:
    """The sums by row of what tasks give: ``add`` gets a task's blocks and returns tables of ``width`` columns at most.

    A task sends a row for each row of its tables that isn't zero; Spark deals these
    by row and adds them up as they come. The tables' size doesn't depend on the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for table in add(_unpacked(batches, training=True)):
            there = np.flatnonzero(table.any(axis=1))
            for part in np.array_split(there, max(1, len(there) >> 13)):
                values = table[part].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array((part + first).astype(np.int32)), pa.array([v.tobytes() for v in values], pa.binary())], names=["row", "sums"])
            first += len(table)
        give_back()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                value = np.frombuffer(raw, np.float32)
                found[row] = found[row] + value if row in found else value.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["row", "sums"])

    parts = blocks.select("train", "lens", "tokens", "leaf", "hashes").mapInArrow(run, "row int, sums binary")
    dealt = parts.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    rows = cut(dealt.mapInArrow(total, "row int, sums binary")).toArrow()  # the tasks' tables go as soon as they are added up
    return dict(zip(rows.column(0).to_pylist(), (np.frombuffer(v, float) for v in rows.column(1).to_pylist())))


def _table(sums: dict[int, np.ndarray], first: int, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width))
    for r, v in sums.items():
        if first <= r < first + rows:
            out[r - first] = v
    return out


def leaf_groups(blocks: DataFrame) -> np.ndarray:
    """Each leaf's group: leaves are halved again and again along the second direction of how they follow one another.

    The counts of followers are a table of ``LEAVES`` rows, whatever the corpus.
    """

    def add(unpacked):
        pairs = np.zeros(LEAVES * LEAVES)
        for _, _, tokens, lens, leaf, _ in unpacked:
            x = leaf[tokens]
            both = x[:-1] * LEAVES + x[1:]
            both = np.delete(both, np.cumsum(lens)[:-1] - 1)  # pairs across two documents
            pairs += np.bincount(both, minlength=LEAVES * LEAVES)
        return [pairs.reshape(LEAVES, LEAVES)]

    follow = _table(_summed(blocks, LEAVES, add), 0, LEAVES, LEAVES)
    near = follow + follow.T + 1e-3
    group = np.zeros(LEAVES, np.int64)
    for _ in range(GROUPS.bit_length() - 1):
        halves = np.empty(LEAVES, np.int64)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            part = near[np.ix_(at, at)]
            root = np.sqrt(part.sum(axis=1))
            vector = np.linalg.eigh(part / root[:, None] / root[None, :])[1][:, -2] / root
            halves[at[np.argsort(vector, kind="stable")]] = 2 * g + (np.arange(len(at)) >= len(at) // 2)
        group = halves
    return group


def _observed(group: np.ndarray, place: np.ndarray):
    def add(unpacked):
        first, second = np.zeros(ROWS * GROUPS), np.zeros(ROWS * IN_GROUP)
        for _, _, tokens, lens, leaf, hashes in unpacked:
            x = leaf[tokens]
            rows = features(tokens, lens, hashes)
            for r, q in zip(rows, inner_features(rows, group[x])):
                first += np.bincount(r * GROUPS + group[x], minlength=len(first))
                second += np.bincount(q * IN_GROUP + place[x], minlength=len(second))
        return [first.reshape(ROWS, GROUPS), second.reshape(ROWS, IN_GROUP)]

    return add


def _expected(shared):
    """What the model expects of the training tokens: for each row the sum of the chances of its tokens."""

    def add(unpacked):
        w: Weights = shared.value
        first, second = np.zeros((ROWS, GROUPS)), np.zeros((ROWS, IN_GROUP))
        for _, _, tokens, lens, leaf, hashes in unpacked:
            rows, group = features(tokens, lens, hashes), w.group[leaf[tokens]]
            inner = inner_features(rows, group)
            # A block's sums have 32 bits, as the chances: adding up is slow where the two differ.
            own = np.zeros(ROWS * GROUPS, np.float32), np.zeros(ROWS * IN_GROUP, np.float32)
            for i in range(0, len(tokens), AT_ONCE):
                part = slice(i, i + AT_ONCE)
                r, q = [x[part] for x in rows], [x[part] for x in inner]
                outer, within = w.odds(r, q, group[part])
                outer /= outer.sum(axis=1, keepdims=True)
                within /= within.sum(axis=1, keepdims=True)
                for k in range(len(BITS)):
                    np.add.at(own[0], (r[k][:, None] * GROUPS + np.arange(GROUPS)).ravel(), outer.ravel())
                    np.add.at(own[1], (q[k][:, None] * IN_GROUP + np.arange(IN_GROUP)).ravel(), within.ravel())
            first += own[0].reshape(first.shape)
            second += own[1].reshape(second.shape)
        return [first, second]

    return add


def train(blocks: DataFrame, shares: np.ndarray, steps: tuple[float, ...] = STEPS) -> Weights:
    """The weights after ``len(steps)`` gradient updates over all training tokens."""
    w = Weights(leaf_groups(blocks), shares)
    seen = _summed(blocks, IN_GROUP, _observed(w.group, w.place))
    observed = _table(seen, 0, ROWS, GROUPS), _table(seen, ROWS, ROWS, IN_GROUP)
    shares = w.group_share, np.tile(w.leaf_share, (ROWS // GROUPS, 1))  # of a row of the second softmax the last bits are the group
    for k, step in enumerate(steps):
        if k == 0:
            expected = [o.sum(axis=1, keepdims=True) * p for o, p in zip(observed, shares)]
        else:
            shared = blocks.sparkSession.sparkContext.broadcast(w)
            found = _summed(blocks, IN_GROUP, _expected(shared))
            expected = _table(found, 0, ROWS, GROUPS), _table(found, ROWS, ROWS, IN_GROUP)
            shared.unpersist()
        for table, o, e, p in zip((w.first, w.second), observed, expected, shares):
            table += (step * np.log((o + PRIOR * p) / (e + PRIOR * p))).astype(np.float32)
    return w


def log_chances(w: Weights, tokens: np.ndarray, lens: np.ndarray, leaf: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log10 of the leaf's probability for each token."""
    rows, x = features(tokens, lens, hashes), leaf[tokens]
    inner, out = inner_features(rows, w.group[x]), np.empty(len(tokens))
    for i in range(0, len(tokens), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        group, place = w.group[x[part]], w.place[x[part]]
        outer, within = w.odds([r[part] for r in rows], [q[part] for q in inner], group)
        at = np.arange(len(group))
        out[part] = np.log10(outer[at, group].astype(float) * within[at, place] / (outer.sum(axis=1, dtype=float) * within.sum(axis=1, dtype=float)))
    return out


# The operator


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the runs of other than white space, A-Z lower-cased, and an end.
    ``held_out`` tells what is not learnt from; if it isn't given, the documents
    whose id's CRC-32, as text, leaves 1 by 5 (a null id counts as no text). base_score and score
    are log10 probabilities of the text, by the words' counts alone and by the model; in both of them words
    that training doesn't hold are one word (of their leaf, in the model). Null and
    blank texts are an end alone. Rows are scored each by itself, repeated ones alike; where
    nothing is learnt from, every score is 0. An empty table gives an empty result.
    Other columns are not read.
    """
    if held_out is None:
        held_out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    encoded = cut(encoded_blocks(rows, "id", "text"))
    words = word_rows(encoded)
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")))
    leaves = Leaves(counts)
    blocks = cut(counted_blocks(encoded, words, counts, leaves))
    weights = train(blocks, leaves.n, steps)
    return _scored(blocks, weights, leaves.train_tokens, docs.schema[id_col].dataType.simpleString(), id_col)


def _scored(blocks: DataFrame, weights: Weights, train_tokens: int, kind: str, id_col: str) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, tokens, lens, leaf, hashes in _unpacked(batches, training=False):
            base, inner, known = (b.column(c)[i].values for c in ("base", "inner", "known"))
            if train_tokens:
                score = inner.to_numpy() + np.add.reduceat(log_chances(shared.value, tokens, lens, leaf, hashes), np.cumsum(lens) - lens)
            else:
                score = np.zeros(len(lens))
            train = b.column("train")[i].values
            yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pc.invert(train), pa.array(lens.astype(np.int64)), known, pa.array(np.full(len(lens), train_tokens)), base, pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        give_back()

    scored = blocks.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
