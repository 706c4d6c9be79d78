"""Substring dedup with an FM-index for each shard.

Windows of ``window`` words are dealt to shards by content: a window belongs to
its minimizer (the least hash among its short n-grams), so all copies of a window
meet in one shard whatever documents they stand in. Consecutive windows with one
minimizer travel together as a segment. A minimizer that occurs once in the
corpus can't belong to a repeated window and is left out before any text moves.

A shard holds each different segment once, with its first place. Its words are
indexed by an FM-index: their Burrows-Wheeler transform in a wavelet matrix of
packed bits with rank counts. Every segment of the documents is in its shard, so
the documents are streamed through the index by walking the shard's own text
backwards, each different segment once: backward search over the wavelet matrix gives, for each position, its
matching statistic (the length of the longest run of words ending there that
stands elsewhere in the shard, up to a window) and that run's interval of the
suffix order. Only statistics of a whole window are above the threshold and
reported; shorter ones are no more than steps of the search. The interval names the
window's content, so the first place of each interval is the one to keep, and
every other place has a match of full length that starts earlier. The documents
then get the answer for each of their segments by its digest. Those windows
are removed.

Repetition that needs no index is settled first: later copies of a whole text
(equal MD5) go entirely, and of windows that a document itself
repeats (found by hash, compared byte by byte) only the first is looked up.

A minimizer with many occurrences (a passage that many documents share, in
different surroundings) is dealt out window by window instead, by the whole
window's hash: equal windows still meet, their surroundings don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, gram_hashes, mix64, utf8, word_hashes, word_spans

WINDOW, GRAM = 20, 8
#: Minimizers with more occurrences are dealt out window by window.
HOT = 1000
#: Words of an index; a shard's segments with one key are never parted.
INDEX_WORDS = 16_384


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank queries over a sequence of small integers, from packed bits."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.starts = levels, None
        n = len(values)
        words = n // 64 + 1
        self.bits = np.zeros((levels, words), dtype=np.uint64)
        self.before = np.zeros((levels, words), dtype=np.int32)
        self.zeros = np.zeros(levels, dtype=np.int32)
        for k in range(levels):
            bit = (values >> (levels - 1 - k) & 1).astype(np.uint8)
            packed = np.zeros(words * 8, dtype=np.uint8)
            row = np.packbits(bit, bitorder="little")
            packed[: len(row)] = row
            self.bits[k] = packed.view(np.uint64)
            self.before[k, 1:] = np.cumsum(np.bitwise_count(self.bits[k]).astype(np.int32))[:-1]
            self.zeros[k] = n - int(bit.sum())
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of level ``k`` before each position."""
        word = at >> 6
        return self.before[k].take(word) + np.bitwise_count(self.bits[k].take(word) & _BELOW.take(at & 63))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions end up when they follow the bits of their symbols through the levels."""
        for k in range(self.levels):
            one = (symbols >> (self.levels - 1 - k) & 1).astype(bool)
            ones = self.ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        if self.starts is None:
            kinds = np.arange(1 << self.levels, dtype=np.int32)
            self.starts = self._down(kinds, np.zeros_like(kinds))
        symbols = np.concatenate([symbols, symbols])
        both = self._down(symbols, np.concatenate([low, high])) - self.starts[symbols]
        return both[: len(low)], both[len(low) :]


class FMIndex:
    """An index of a word sequence, sorted deeply enough for matches of up to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        rank, h = text.astype(np.int64), 1
        order = np.argsort(rank)
        while h < depth + 1:
            beyond = np.zeros(n, dtype=np.int64)
            beyond[: n - h] = rank[h:] + 1 if n > h else 0
            key = rank * (n + int(text.max()) + 2) + beyond
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            h *= 2
            if rank[order[-1]] == n - 1:
                break  # every suffix has its place
        kinds = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))]).astype(np.int32)
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int32), max(1, (kinds - 1).bit_length()))

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position in ``ends``: how many words of ``text`` that end there, ``most`` at most, stand at two or more places of the index, and their suffix interval.

        All searches step backward together; each ends where its interval holds no
        second suffix. A position whose very word stands once has statistic 0 and an
        empty interval.
        """
        length, low, high = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
        text = text.astype(np.int32)  # an index holds far fewer words than that
        going, last = np.arange(len(ends)), text[ends]
        a, b = self.first[last], self.first[last + 1]
        for n in range(1, most + 1):
            more = b - a > 1
            going, a, b = going[more], a[more], b[more]
            if not len(going):
                break
            length[going], low[going], high[going] = n, a, b
            if n < most:
                c = text[ends[going] - n]
                x, y = self.wavelet.rank(c, a, b)
                a, b = self.first[c] + x, self.first[c] + y
        return length, low, high


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Of each window of ``width`` grams, where its least one stands; of equal ones the first."""
    return np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)


class _Part:
    """The words of some texts, end to end, and their windows; those that reach over a text's end are not ``valid``."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        buf = b"\n".join(texts)
        starts, ends = word_spans(buf)
        self.hashes, self.window = word_hashes(buf, starts, ends), window
        self.buf, self.starts, self.ends = buf, starts, ends
        self.edge = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.edge))
        n = max(0, len(self.row) - window + 1)
        self.valid = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, dtype=bool)
        self._own = None

    @property
    def own_first(self) -> np.ndarray:
        """Windows that are valid and no repetition of an earlier one of their own text."""
        if self._own is None:
            key = gram_hashes(self.hashes, self.window) ^ mix64(self.row[: len(self.valid)].astype(np.uint64))
            at = np.flatnonzero(self.valid)
            self._own = self.valid.copy()
            ordered = np.sort(key[at])
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                at = at[np.isin(key[at], twice)]
                at = at[np.argsort(key[at], kind="stable")]
                new = np.concatenate([[True], key[at][1:] != key[at][:-1]])
                first = at[new][np.cumsum(new) - 1]
                self._own[at[~new & self._equal(first, at)]] = False
        return self._own

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at ``a`` and ``b`` have the same words."""
        lengths = self.ends - self.starts
        same = np.ones(len(a), dtype=bool)
        for j in range(self.window):
            same &= lengths[a + j] == lengths[b + j]
        raw = np.frombuffer(self.buf, dtype=np.uint8)
        words = raw[~((raw == 32) | ((raw >= 9) & (raw <= 13)))].tobytes()
        place = np.concatenate([[0], np.cumsum(lengths)])
        size = place[a + self.window] - place[a]
        at = np.flatnonzero(same)
        same[at] = [words[i : i + n] == words[j : j + n] for i, j, n in zip(place[a[at]].tolist(), place[b[at]].tolist(), size[at].tolist())]
        return same


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, uid, text) to (minimizer, uid, place): runs of windows, those left out that their document repeats.

    ``place`` is the first window times 256 and the number of windows.
    """
    for b in batches:
        known, uids = np.asarray(b.column(0).is_valid()), b.column(1).to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for first, texts in by_bytes([t or b"" for t in utf8(b.column(2))]):
            p = _Part(texts, window)
            at = np.flatnonzero(p.own_first & known[first + p.row[: len(p.valid)]])
            if not len(at):
                continue
            grams = gram_hashes(p.hashes, gram)
            least = minimizers(grams, window - gram + 1)[at]
            start = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(least) != 0) | (np.diff(p.row[at]) != 0)]))
            begin = at[start]
            out[0].append(grams[least[start]].view(np.int64))
            out[1].append(uids[first + p.row[begin]])
            out[2].append((begin - p.edge[p.row[begin]]) * 256 + np.diff(np.append(start, len(at))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64)) for c in out], names=["m", "uid", "place"])


def _occurrences(batches: Iterator[pa.RecordBatch], window: int, with_words: bool) -> Iterator[pa.RecordBatch]:
    """(id, uid, text, segments) to (shard, content, id, uid, first window, windows[, words]); hot segments window by window."""
    names = ["shard", "content", "id", "uid", "first", "size", *["words"] * with_words]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for b in batches:
        ids, uids = b.column(0).to_pylist(), b.column(1).to_pylist()
        lists, rows, held = b.column(3), [], 0
        for row, text in enumerate(utf8(b.column(2))):
            words = text.split()
            whole = None
            for s in lists[row].as_py():
                first, size = divmod(s["place"], 256)
                pieces = [(first, size, s["m"])]
                if s["hot"]:
                    whole = gram_hashes(word_hashes(text, *word_spans(text)), window).view(np.int64) if whole is None else whole
                    pieces = [(p, 1, int(whole[p])) for p in range(first, min(first + size, len(whole)))]
                for first, size, shard in pieces:
                    part = words[first : first + size + window - 1]
                    if len(part) < size + window - 1:
                        continue  # the place is of another text whose uid is equal
                    content = b" ".join(part)
                    digest = hashlib.blake2b(content, digest_size=16).digest()
                    rows.append((shard, digest, ids[row], uids[row], first, size, content)[: len(names)])
                    held += len(content)
            if held > 1 << 22 or len(rows) > 50_000:
                yield batch(rows)
                rows, held = [], 0
        yield batch(rows)


def _first_places(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, content, id, first, words) to (shard, content, ids, firsts): where each window of the segment first stands."""
    held: list[pa.RecordBatch] = []
    words, last = 0, None

    def index() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: rows[name].chunk(0)
        split = pc.split_pattern(column("words"), " ")
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        numbers = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)  # 0 parts the segments
        text[np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
        windows = sizes - window + 1
        ends = np.cumsum(windows)
        step = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)
        at = np.repeat(np.cumsum(sizes + 1) - sizes - 1, windows) + step
        own = np.repeat(column("id").to_numpy(), windows)
        place = np.repeat(column("first").to_numpy().astype(np.int64), windows) + step
        length, low, _ = FMIndex(text, window).matching_statistics(text, at + window - 1, window)
        low = np.where(length == window, low, -1 - at)  # the others stand once: they are their own first place
        order = np.lexsort((place, own, low))
        new = np.concatenate([[True], low[order][1:] != low[order][:-1]])
        best = np.empty(len(order), dtype=np.int64)
        best[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [column("shard"), column("content"), pa.ListArray.from_arrays(offsets, pa.array(own[best], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(place[best], pa.int32()))],
            names=["shard", "content", "ids", "firsts"],
        )

    for b in batches:
        if not len(b):
            continue
        shards = b.column(0).to_numpy()
        total = np.cumsum(pc.count_substring(b.column(4), " ").to_numpy() + 2)
        begins = np.concatenate([[last is not None and shards[0] != last], shards[1:] != shards[:-1]])
        at = done = 0  # rows and words of this batch that have been indexed
        for k in np.flatnonzero(begins).tolist():
            here = int(total[k - 1]) if k else 0
            if words + here - done >= INDEX_WORDS:
                held.append(b.slice(at, k - at))
                yield index()
                held, words, at, done = [], 0, k, here
        held.append(b.slice(at))
        words, last = words + int(total[-1]) - done, shards[-1]
    if held:
        yield index()


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(row id, text, copy, lists of repeated windows) to counts, the removed spans of words and the kept words."""
    for b in batches:
        known, copy, lists = b.column(0).is_valid().to_pylist(), b.column(2).to_pylist(), b.column(3)
        out: list[list] = [[], [], [], []]
        for first, texts in by_bytes([t or b"" for t in utf8(b.column(1))]):
            p = _Part(texts, window)
            for k, t in enumerate(texts):
                words, i, spans = t.split(), first + k, np.empty((0, 2), dtype=np.int64)
                if len(words) >= window and known[i]:
                    s = p.edge[k]
                    repeated = np.ones(len(words) - window + 1, dtype=bool) if copy[i] else ~p.own_first[s : s + len(words) - window + 1]
                    for starts in lists[i].as_py() or []:
                        repeated[starts] = True
                    at = np.flatnonzero(repeated)
                    if len(at):
                        # Windows that touch or overlap make one span.
                        new = np.flatnonzero(np.diff(at) > window) + 1
                        spans = np.stack([at[np.append(0, new)], at[np.append(new - 1, len(at) - 1)] + window], axis=1)
                out[0].append(len(words))
                out[1].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out[2].append([{"start": s, "end": e} for s, e in spans.tolist()])
                for s, e in spans[::-1].tolist():
                    del words[s:e]
                out[3].append(b" ".join(words).decode())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind), pa.array(out[3], pa.string())], names=["id", "n_words", "n_removed", "removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_removed, removed (spans of words, end excluded) and kept (the other words, joined by spaces).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if a window of
    ``window`` words that covers it also starts earlier: in a document of smaller
    id, or earlier in the same one. Windows are judged on the input. A null text
    has no words; a row with a null id keeps all its words and removes none; rows
    repeated under one id don't remove each other's words, for neither is earlier.
    Each row of ``docs`` gives one row; other columns are not read. A row is known
    by its id and a 64-bit hash of its text, equal segments by 128-bit digests.
    """
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("bigint")
    rows = docs.select(own.alias("id"), F.xxhash64(own, text).alias("uid"), text.alias("text"))
    # Later copies of whole texts.
    digests = docs.where(own.isNotNull() & text.isNotNull()).select(own.alias("id"), F.xxhash64(own, text).alias("uid"), F.unhex(F.md5(text.cast("binary"))).alias("md5"))
    # Written, so that the join has plain shuffles on both sides and a large group of copies can be parted among tasks.
    first = cut(digests.groupBy("md5").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = cut(digests.join(first, "md5").where("id > first").select("id", "uid").distinct())

    segments = rows.mapInArrow(lambda b: _segments(b, window, gram), "m bigint, uid bigint, place bigint")
    often = segments.groupBy("m").agg(F.count("*").alias("n")).where("n > 1")
    listed = segments.join(often, "m").groupBy("uid").agg(F.collect_set(F.struct("m", "place", (F.col("n") > hot).alias("hot"))).alias("segments"))
    listed = cut(listed.join(copies.select("uid"), "uid", "left_anti"))

    lists = rows.join(listed, "uid").select("id", "uid", "text", "segments")
    found = "shard bigint, content binary, id bigint, uid bigint, first int, size int"
    held = lists.mapInArrow(lambda b: _occurrences(b, window, True), f"{found}, words binary")
    contents = held.groupBy("shard", "content").agg(F.min(F.struct("id", "first")).alias("place"), F.first("words").alias("words"))
    contents = contents.select("shard", "content", "place.id", "place.first", "words").repartition("shard").sortWithinPartitions("shard", "content")
    places = contents.mapInArrow(lambda b: _first_places(b, window), "shard bigint, content binary, ids array<bigint>, firsts array<int>")

    where = lists.mapInArrow(lambda b: _occurrences(b, window, False), found).join(places, ["shard", "content"])
    again = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: ~((F.get("ids", i) == F.col("id")) & (F.get("firsts", i) == F.col("first") + i)))
    starts = where.select("id", "uid", F.transform(again, lambda i: F.col("first") + i).alias("starts")).where("size(starts) > 0")
    marks = starts.select("id", "uid", "starts", F.lit(False).alias("copy")).unionByName(copies.select("id", "uid", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    marks = cut(marks.groupBy("id", "uid").agg(F.collect_set("starts").alias("starts"), F.max("copy").alias("copy")))
    judged = rows.join(marks, ["id", "uid"], "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    done = judged.mapInArrow(lambda b: _kept(b, window), "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string")
    return done.withColumnRenamed("id", id_col)
