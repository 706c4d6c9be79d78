"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts with one state that has a loop for each
byte. Each merge a+b -> c, in rank order, adds a gadget: the state that ``a``
leads to is copied without its ``b`` arc (what followed as b must now have been
merged), ``a`` leads to the copy, and every state with an ``a`` arc gets a ``c``
arc to where ``b`` led. In this construction a token's arcs all end in one
state, so a state is written as (token, number of its own removals) over the
state it was copied from, and the arcs are looked up instead of copied.

Exactly one path of the automaton spells a given byte string: the one that
greedy merging by rank finds. Texts are split into pieces by whole arrays, each
different piece of some millions of characters is encoded once, all of them side
by side: transition tables give the arcs that start at every byte, and the
pieces follow them from offset to offset. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, tokenizer_file
from .token_counts import LETTER_SPANS, NUMBER_SPANS, WHITE, byte_characters

#: Characters that are encoded together; longer texts are parted where white space begins.
TOGETHER = 2_000_000
#: Pieces of more bytes are encoded one by one.
LONG_PIECE = 64
#: Transitions whose answer is kept.
MAX_TABLE = 500_000

OTHER, LETTER, NUMBER, SPACE = range(4)


def _kinds() -> np.ndarray:
    """The kind of every character."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for kind, spans in ((LETTER, LETTER_SPANS), (NUMBER, NUMBER_SPANS)):
        for first, last in spans:
            kinds[first : last + 1] = kind
    kinds[[ord(c) for c in re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))]] = SPACE
    return kinds


KINDS = _kinds()


def split_pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The pieces of ``texts``, end to end: the bytes, where in them each piece begins (and the end), and each text's first piece (and their number).

    The rule of the public byte-level vocabulary: after an apostrophe s, t, re, ve,
    m, ll or d is a piece with it; runs of letters, of numbers and of other
    characters are pieces, each with a blank before it; of a run of white space
    before one of those the last character stands alone, unless it is that blank.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    n = len(points)
    edge = np.cumsum([0, *map(len, texts)])
    kind = KINDS[points]
    opens = np.zeros(n + 3, dtype=bool)  # a text begins
    opens[edge] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(start & (kind != SPACE) & ~opens[:n])  # of runs that follow something
    begins = begins[kind[begins - 1] == SPACE]
    start[begins - 1] = True
    start[begins[points[begins - 1] == 0x20]] = False
    # An apostrophe that begins a piece, before letters.
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~opens[at + 1]]
    one = points[at + 1]
    two = np.where((at + 2 < n) & ~opens[at + 2], points[np.minimum(at + 2, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    fits = single | double
    at, size = at[fits], np.where(single, 2, 3)[fits]
    start[at + 1] = False
    start[(at + size)[at + size < n]] = True

    data = joined.encode()
    begin = np.flatnonzero(start)
    offsets = np.append(begin, n)
    if len(data) > n:
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    return data, offsets, np.searchsorted(begin, edge)


class Table:
    """An open-addressed hash table from integers >= 0 to integers, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        self.bits = max(10, (2 * max(len(keys), room)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=values.dtype)
        self.held = 0
        self.put(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are different from each other and from those held."""
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        self.held += len(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot one stays
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not held."""
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], -1)
        at = np.flatnonzero((held != keys) & (held >= 0))
        keys, slots = keys[at], slots[at]
        while len(at):
            slots = (slots + 1) & mask
            held = self.keys[slots]
            hit = held == keys
            out[at[hit]] = self.values[slots[hit]]
            go = ~hit & (held >= 0)
            at, keys, slots = at[go], keys[go], slots[go]
        return out


class Automaton:
    """Encodes and decodes under the byte-level vocabulary in ``spec`` (the bytes of a tokenizer .json)."""

    def __init__(self, spec: bytes) -> None:
        j = json.loads(spec)
        model = j["model"]
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.size = size = 1 + max([*vocab.values(), *special.values()])
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = bytes(byte_of[c] for c in text)
        for text, i in special.items():
            self.labels[i] = text.encode()
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.gap = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        self.lengths = np.array([len(x) for x in self.labels], dtype=np.int64)

        self.left = [-1] * size  # the first part of a merged token
        self.born = [-1] * size  # the merge that made it
        self.removed: list[dict[int, tuple[int, int]]] = [{} for _ in range(size)]  # by token: removed arc -> (how many before it, merge)
        self.base: list[tuple[int, int]] = [(-1, 0)] * size  # the state that a token's first state equals
        for time, m in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self._gadget(a, b, vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)], time)

        # A trie over the labels: (node * 256 + byte) -> node, and the token that ends at each node.
        self.next: dict[int, int] = {}
        self.ends = [-1]
        for i in vocab.values():
            node = 0
            for byte in self.labels[i]:
                node = self.next.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.known: dict[int, bool] = {}
        self._compile()

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        after_b = (b, len(self.removed[b]))
        if self.has_arc((a, len(self.removed[a])), b):
            self.removed[a][b] = (len(self.removed[a]), time)
        self.left[c], self.born[c], self.base[c] = a, time, after_b

    def _compile(self) -> None:
        """Lays the automaton out in tables of integers."""
        as_array = lambda x: np.array(list(x), dtype=np.int64)
        self.left_of, self.born_at = as_array(self.left), as_array(self.born)
        self.base_token, self.base_removed = as_array(x for x, _ in self.base), as_array(n for _, n in self.base)
        self.removals = as_array(map(len, self.removed))
        gone = [(a * self.size + b, n << 32 | time) for a, arcs in enumerate(self.removed) for b, (n, time) in arcs.items()]
        self.gone = Table(as_array(k for k, _ in gone), as_array(v for _, v in gone))
        self.end_token = as_array(self.ends)
        self.step = Table(as_array(self.next), as_array(self.next.values()))
        self.second = self.step.get((np.repeat(self.step.get(np.arange(256)), 256) << 8) | np.tile(np.arange(256), 256))
        self.answers = Table(np.empty(0, np.int64), np.empty(0, np.int8), MAX_TABLE)

    def has_arc(self, state: tuple[int, int], token: int) -> bool:
        """Whether ``state`` has an arc for ``token``: nothing on the token's left spine was removed before it grew."""
        spine, t, grown = [], token, 1 << 60
        while t >= 0:
            spine.append((t, grown))
            t, grown = self.left[t], self.born[t]
        owner, n = state
        while owner >= 0:
            gone = self.removed[owner]
            if gone:
                for t, grown in spine:
                    hit = gone.get(t)
                    if hit is not None and hit[0] < n and hit[1] <= grown:
                        return False
            owner, n = self.base[owner]
        return True

    def has_arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``has_arc`` of the state after each token of ``last``, for each token of ``token``."""
        fits = np.ones(len(last), dtype=bool)
        at, owner, n, tokens = np.arange(len(last)), last, self.removals[last], token
        while len(at):
            i, t, grown = np.arange(len(at)), tokens, np.full(len(at), 1 << 40)
            while len(i):
                hit = self.gone.get(owner[i] * self.size + t)
                fits[at[i[(hit >= 0) & (hit >> 32 < n[i]) & ((hit & 0xFFFFFFFF) <= grown)]]] = False
                t, grown = self.left_of[t], self.born_at[t]
                more = (t >= 0) & fits[at[i]]
                i, t, grown = i[more], t[more], grown[more]
            owner, n = self.base_token[owner], self.base_removed[owner]
            more = (owner >= 0) & fits[at]
            at, owner, n, tokens = at[more], owner[more], n[more], tokens[more]
        return fits

    def follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The transition table, filled as it is used."""
        keys = last * self.size + token
        out = self.answers.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            asked, where = np.unique(keys[new], return_inverse=True)
            found = self.has_arcs(asked // self.size, asked % self.size).astype(np.int8)
            out[new] = found[where]
            if self.answers.held + len(asked) > MAX_TABLE:
                self.answers = Table(np.empty(0, np.int64), np.empty(0, np.int8), MAX_TABLE)
            if len(asked) <= MAX_TABLE:
                self.answers.put(asked, found)
        return out > 0

    def encode_piece(self, raw: bytes) -> list[int]:
        """The tokens of one piece, byte by byte."""
        n = len(raw)
        come = [-1] * (n + 1)  # the token on the path's arc into each position
        step, ends, table, size = self.next.get, self.ends, self.known, self.size
        for i in range(n):
            last, node = come[i], 0
            for j in range(i, n):
                node = step(node << 8 | raw[j])
                if node is None:
                    break
                t = ends[node]
                if t >= 0:
                    fits = last < 0 or table.get(last * size + t)
                    if fits is None:
                        if len(table) >= MAX_TABLE:
                            table.clear()
                        fits = table[last * size + t] = self.has_arc((last, len(self.removed[last])), t)
                    if fits:
                        come[j + 1] = t
        out = []
        while n:
            t = come[n]
            out.append(t)
            n -= len(self.labels[t])
        return out[::-1]

    def encode_pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces that lie end to end in ``raw``, and how many each has."""
        sizes = np.diff(offsets)
        pieces = len(sizes)
        owner = np.repeat(np.arange(pieces), sizes)
        # Every arc of the automaton's tables that spells bytes of a piece: from, to and token.
        p = np.flatnonzero((sizes <= LONG_PIECE)[owner])
        end = offsets[1:][owner[p]]
        arcs = [(p, np.ones(len(p), dtype=np.int64), self.end_token[self.step.get(raw[p].astype(np.int64))])]
        size, node = 1, None
        while len(p):
            size += 1
            more = p + size <= end
            p, end = p[more], end[more]
            node = self.second[raw[p].astype(np.int64) << 8 | raw[p + 1]] if node is None else self.step.get(node[more] << 8 | raw[p + size - 1])
            more = node >= 0
            p, end, node = p[more], end[more], node[more]
            token = self.end_token[node]
            ends = np.flatnonzero(token >= 0)
            arcs.append((p[ends], np.full(len(ends), size), token[ends]))
        start, length, token = (np.concatenate(x) for x in zip(*arcs))
        piece = owner[start]
        depth = (start - offsets[piece]).astype(np.uint8)
        order = np.argsort(depth, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
        start, token, length = (start + piece)[order], token[order], length[order]  # each piece has one place more than bytes
        come = np.full(len(raw) + pieces, -1, dtype=np.int64)
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
            a, t, to = start[i:j], token[i:j], (start + length)[i:j] if k == 0 else start[i:j] + length[i:j]
            if k:
                fits = self.follow(come[a], t)
                t, to = t[fits], to[fits]
            come[to] = t

        # Back along the path from each piece's end.
        at, low = offsets[1:] + np.arange(pieces), offsets[:-1] + np.arange(pieces)
        left = np.flatnonzero((sizes > 0) & (sizes <= LONG_PIECE))
        rounds, count = [], np.zeros(pieces, dtype=np.int64)
        while len(left):
            t = come[at[left]]
            rounds.append((left, t))
            count[left] += 1
            at[left] -= self.lengths[t]
            left = left[at[left] > low[left]]
        longer = {int(k): self.encode_piece(raw[offsets[k] : offsets[k + 1]].tobytes()) for k in np.flatnonzero(sizes > LONG_PIECE)}
        for k, ids in longer.items():
            count[k] = len(ids)
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if pieces else 0, dtype=np.int64)
        for r, (who, t) in enumerate(rounds):
            out[ends[who] - 1 - r] = t
        for k, ids in longer.items():
            out[ends[k] - len(ids) : ends[k]] = ids
        return out, count

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        data, offsets, first = split_pieces(parts)
        if not data:
            return [b""] * len(parts)
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)]).dictionary_encode()
        which, kinds = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary
        ends = np.frombuffer(kinds.buffers()[1], dtype="<i4")[kinds.offset : kinds.offset + len(kinds) + 1].astype(np.int64)
        raw = np.frombuffer(kinds.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        tokens, count = self.encode_pieces(raw, ends - ends[0])
        number = count[which]
        total = np.cumsum(number)
        shift = np.cumsum(count)[which] - total  # from a place in the output to one in ``tokens``
        ids = tokens[np.arange(int(total[-1])) + np.repeat(shift, number)].astype("<u4")
        edge = np.concatenate([[0], total])[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """A text in parts that encode by themselves; specials as the bytes of their ids."""
        for k, part in enumerate(self.special_split.split(text) if self.special_split and "<" in text else [text]):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            while len(part) > TOGETHER and (gap := self.gap.search(part, TOGETHER)):
                yield part[: gap.start()]
                part = part[gap.start() :]
            if part:
                yield part

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[str] = []
        places: list[tuple[int, int]] = []

        def give() -> None:
            for (i, k), ids in zip(places, self._encode_parts(held)):
                out[i][k] = ids
            held.clear()
            places.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self._parts(text):
                out[i].append(part if isinstance(part, bytes) else b"")
                if isinstance(part, str):
                    if held and size + len(part) > TOGETHER:
                        give()
                        size = 0
                    held.append(part)
                    places.append((i, len(out[i]) - 1))
                    size += len(part)
        give()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


def bpe_encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text encoded: ``id_col``, ids (little-endian unsigned 32-bit integers), n_tokens.

    One row in gives one row out, repeated rows included; a null text counts as
    empty and has no ids; a null id stays null; other columns are not read.
    Memory is bounded by an Arrow batch, what ``TOGETHER`` characters need and a
    bounded table. No shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(spec.value)  # a task's own, so that an idle worker holds nothing
        for b in batches:
            ids = a.encode_all([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["id", "ids", "n"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"id {kind}, ids binary, n bigint").select(F.col("id").alias(id_col), "ids", F.col("n").alias("n_tokens"))


def bpe_decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: ``id_col``, text. Null ids give null; bytes that are not UTF-8 become U+FFFD."""
    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else a.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"id {kind}, text string").select(F.col("id").alias(id_col), "text")


def bpe_round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass.

    The same rules as ``bpe_encode``: a null or empty text has no tokens and the
    hashes of the empty string.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(spec.value)
        for b in batches:
            rows = [[], [], []]
            for ids in a.encode_all([t or "" for t in b.column(1).to_pylist()]):
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["id", "n", "i", "d"])

    source = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"id {kind}, n bigint, i string, d string").toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
