"""The two tokenizers against the library, and their edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lexweave.llm.bpe_automaton import Automaton, Table, bpe_decode, bpe_encode, bpe_round_trip
from lexweave.llm.common import tokenizer_file
from lexweave.llm.token_counts import MergeCounter, token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

PIECES = ["a", "aa", "aaa", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "ΑΣ", "İ", "é", "é", "中", "1", "23", "'s", "'LL", "!!", "🎉", "ß", "ing", "\x00", "\x1c", " ", "----", "===", "\r\n", "zz", "ee", "\u2003", "\u3000", "\x85", "\u2028", "\u1680", "\u200b", "'", "'re", "'v", "'ve", "l", "s"]


def texts(n: int = 1500) -> list[str]:
    r = random.Random(5)
    made = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*made, *("a" * k for k in range(1, 40)), "ab" * 60, "x" * 3000, ""]


def library(name: str):
    t = tokenizers.Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_equal_the_library():
    t, own = library("word_bpe_49k.json"), MergeCounter(tokenizer_file("word_bpe_49k.json"))
    for x in texts():
        assert own.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_ids_and_text_equal_the_library():
    t, own = library("byte_bpe_50k.json"), Automaton(tokenizer_file("byte_bpe_50k.json"))
    for x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(x), "<u4").tolist() == ids, repr(x)
        assert own.decode(own.encode(x)) == t.decode(ids, skip_special_tokens=False) == x


def test_pieces_encoded_together_equal_the_library(monkeypatch):
    from lexweave.llm import bpe_automaton

    t, own = library("byte_bpe_50k.json"), Automaton(tokenizer_file("byte_bpe_50k.json"))
    every = [*texts(3000), "x's's 's'sx 'll'l ''s don't\n's a  'sb 'r 'ree '", "\u3000x \t y \n", *("'" + x for x in PIECES)]
    every.append(" ".join(every))
    expected = [e.ids for e in t.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(every)] == expected
    # Texts parted, the table of transitions filled up again and again, and every piece by itself.
    monkeypatch.setattr(bpe_automaton, "TOGETHER", 500)
    monkeypatch.setattr(bpe_automaton, "MAX_TABLE", 300)
    fresh = Automaton(tokenizer_file("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in fresh.encode_all(every)] == expected
    monkeypatch.setattr(bpe_automaton, "LONG_PIECE", 0)
    assert [np.frombuffer(x, "<u4").tolist() for x in fresh.encode_all(every)] == expected


def test_table_of_integers():
    r = np.random.default_rng(8)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    table = Table(keys[::2], np.arange(len(keys[::2])))
    assert (table.get(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.get(keys[1::2]) == -1).all()
    table.put(keys[1::2], np.arange(len(keys[1::2])) + 10**6)
    assert (table.get(keys[1::2]) >= 10**6).all() and len(table.get(keys[:0])) == 0


def test_queries_on_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the cat", "x"), (3, "the cat " * 2000, "x"), (3, "the cat " * 2000, "x")], "doc_id bigint, text string, n_tokens string")
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect()}
    assert counted == {(1, 0, 0, False), (2, 0, 0, False), (None, 7, 2, False), (3, 16000, 4000, True)}
    rows = bpe_round_trip(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 5 and all(r.ids_sha256 == r.decoded_sha256 == empty for r in rows if r.doc_id in (1, 2))
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(docs)).collect()}
    assert back == {1: "", 2: "", None: "the cat", 3: "the cat " * 2000}
    assert token_counts(docs.limit(0)).count() == bpe_round_trip(docs.limit(0)).count() == 0
