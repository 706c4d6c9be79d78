"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import ensure_checkpoint_dir, small_batches

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93 | 1)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there; lost executors lose nothing.

    The shuffle files of the job that made it are not needed any more and go when it ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, made under the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_file(name: str) -> bytes:
    """The bytes of a public tokenizer file; ``name`` may also be a path."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, "rb") as f:
        return f.read()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    a = np.frombuffer(buf, dtype=np.uint8)
    word = np.zeros(len(a) + 2, dtype=np.int8)
    word[1:-1] = ~((a == 32) | ((a >= 9) & (a <= 13)))
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _BYTE_BASE, dtype=np.uint64))
    first = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    a = np.frombuffer(buf, dtype=np.uint8)
    value = (a[~((a == 32) | ((a >= 9) & (a <= 13)))].astype(np.uint64) + np.uint64(1)) * powers[offset]
    return mix64(np.add.reduceat(value, first))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of consecutive word hashes; empty if there are fewer than k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * _GRAM_BASE + words[j : j + n]
    return mix64(acc)


def by_bytes(texts: Iterable[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in lists of about ``limit`` bytes, each with the index of its first text."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes, null as None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class Cache(dict):
    """What ``make`` gives for short texts; long ones are made each time.

    When ``most`` are held they become the old half, from which what is asked for
    again moves back; so at most twice as many are held and frequent ones stay.
    """

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle workers stay alive beside active ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def released(run):
    """``run`` over a task's batches; afterwards what it held goes back to the system."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


class Forest:
    """Union-find over the integers it has seen; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        """(root, member) for each member that is not a root."""
        return [(self.find(x), x) for x in list(self.parent) if self.find(x) != x]
