"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of symbols. A heap holds its adjacent pairs by
rank; the lowest is popped and merged again and again until none is left. The
count is the number of first symbols less the merges; no identifier is made.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, released, tokenizer_file

# The Unicode White_Space characters, as a character-class body.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _spans(initial: str) -> list[tuple[int, int]]:
    """The first and last characters of the runs whose general category starts with ``initial``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return out


LETTER_SPANS, NUMBER_SPANS = _spans("L"), _spans("N")
# The same as character-class bodies.
LETTERS, NUMBERS = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) for spans in (LETTER_SPANS, NUMBER_SPANS))
# Fixed value: the pre-split pattern of the public word-end vocabulary.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+"

MAX_CACHED_WORDS = 200_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + extra)
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of whole texts under the vocabulary in ``spec`` (the bytes of a tokenizer .json)."""

    def __init__(self, spec: bytes) -> None:
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        special = sorted((t["content"] for t in j.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = re.compile(WORD_PATTERN)
        self.cache = Cache(self.count_word, MAX_CACHED_WORDS)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        return [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]

    def count_word(self, word: str) -> int:
        ids = self.symbols(word)
        n, merges = len(ids), self.merges
        if n == 1:
            return 1
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            done += 1
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], made))
        return n - done

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.special and "<" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                # Lower case goes by single characters, so that a final sigma stays an ordinary one.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(self.cache.__getitem__, self.words.findall(part.lower())))
        return total


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit``).

    One row in gives one row out, repeated rows included; a null or empty text
    counts 0 bytes and 0 tokens; a null id stays null; other columns are not
    read. Memory is bounded by one Arrow batch and a word cache of
    ``MAX_CACHED_WORDS``. There is no shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = MergeCounter(spec.value)  # a task's own, so that an idle worker holds nothing
        for b in batches:
            tokens = [known.count(t) if t else 0 for t in b.column(1).to_pylist()]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(tokens, pa.int64())], names=["id", "b", "n"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"id {kind}, b bigint, n bigint").select(F.col("id").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
