"""References, text functions and identities, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import ids, refs, text, vectors
from lexweave.functions.stemmer import stem


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


REFS = {
    "RD-1428/2003#art34.1": ("RD-1428/2003", "34", "1", None),
    " RD 1428/2003 # Artículo 14 bis ": ("RD-1428/2003", "14bis", None, None),
    "RD–1428/2003#Art. 3": ("RD-1428/2003", "3", None, None),
    "ley-1/2000": ("ley-1/2000", None, None, None),
    "RD-1/2003#art5.2.b": ("RD-1/2003", "5", "2.b", None),
    "RD-1/2003#artt-3.1": ("RD-1/2003", "t-3", "1", None),
    "": (None, None, None, "empty"),
    None: (None, None, None, "empty"),
    "RD-1/2003#art1#art2": (None, None, None, "several references"),
    "RD/2003#art1": (None, None, None, "unknown norm"),
    "RD-1/2003#5": (None, None, None, "no article mark"),
    "RD-1/2003#art": (None, None, None, "mark without designator"),
    "RD-1/2003#art5.": (None, None, None, "empty paragraph"),
    "RD-1/2003#art.": (None, None, None, "mark without designator"),
    "RD-1/2003#art5_": (None, None, None, "designator not canonical"),
    "RD-1/2003#art5.-": (None, None, None, "paragraph not canonical"),
}


def test_parse_ref(spark):
    rows = spark.createDataFrame([(k,) for k in REFS], "x string").select("x", refs.parse_ref(F.col("x")).alias("p")).collect()
    assert {r.x: tuple(r.p) for r in rows} == REFS


def test_parse_strict_fails(spark):
    with pytest.raises(Exception, match="unknown norm"):
        one(spark, "nothing", refs.parse_ref_strict)


def test_levels_and_matches(spark):
    n, a, p, q = "N-1/2000", "N-1/2000#art1", "N-1/2000#art1.2", "N-1/2000#art1.3"
    cases = [(n, p, 0, True), (a, p, 0, True), (a, p, 1, True), (p, q, 1, True), (p, q, 2, False), (p, p, 2, True), (a, a, 2, False), (n, n, 1, False), (a, "N-2/2000#art1", 0, False)]
    df = spark.createDataFrame(cases, "a string, b string, l int, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", refs.refs_match(F.col("a"), F.col("b"), F.col("l"))).collect())
    belongs = [(p, a, True), (a, p, False), (p, q, False), (a, n, True), (p, p, True)]
    df = spark.createDataFrame(belongs, "c string, r string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", refs.cites(F.col("c"), F.col("r"))).collect())
    assert one(spark, p, refs.article_of) == a and one(spark, n, refs.article_of) == n


def brute_segments(t):
    """The definition, over a list."""
    parts = [x.strip() for x in re.split(text.SENTENCE_END.replace("(?U:\\s)", "\\s"), t)]
    pieces = []
    for s in filter(None, parts):
        if len(s) <= 300:
            pieces.append(s)
            continue
        line = ""
        for w in s.split(" "):
            for w_ in [w[i : i + 300] for i in range(0, len(w), 300)] if len(w) > 300 else [w]:
                if line and len(line) + 1 + len(w_) > 300:
                    pieces.append(line)
                    line = w_
                else:
                    line = f"{line} {w_}" if line else w_
        if line:
            pieces.append(line)
    out = []
    for p in pieces:
        if out and len(out[-1]) < 12:
            out[-1] += " " + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < 12:
        out[-2:] = [out[-2] + " " + out[-1]]
    return out


def test_segments(spark):
    r = random.Random(3)
    bits = ["Artículo 34. Cómputo. ", "1. Se contará. ", "Sí. ", "No: ", "fin;\n", "palabra ", "otra ", "x" * 350 + " ", "¿Qué? ", "Es 1.500 m. Ahora. ", "\n\n", "«Cita» "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["", "a", "Uno.\nDos."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.segments(F.col("t")).alias("s")).collect()
    for row in rows:
        assert row.s == brute_segments(row.t), row.t


def test_normalisations_differ_on_purpose(spark):
    x = " “Año”\u00a0 ﬁn – 3 "
    assert one(spark, x, text.normalize_content) == "“Año” ﬁn – 3"
    assert one(spark, x, text.fold_for_compare) == '"Año" fin - 3'
    assert one(spark, "  TÍTULO  Ñ ", text.strip_accents) == "titulo  n"
    assert one(spark, "¿Qué dice el RD 1.500?", text.query_terms) == ["qué", "dice", "el", "rd", "1", "500"]
    assert "".join(one(spark, "a  b\nc ", text.tokens_of_stream)) == "a  b\nc "


def test_identities(spark):
    assert one(spark, "uri", ids.doc_id) == hashlib.sha256(b"uri").hexdigest()[:16]
    want = hashlib.blake2b(b"docabc0", digest_size=16).hexdigest()
    assert spark.range(1).select(ids.chunk_id(F.lit("doc"), F.lit("abc"), F.lit(0)).alias("c")).first().c == want
    assert spark.range(1).select(ids.recording_key(F.lit("m"), F.lit("t")).alias("k")).first().k == hashlib.sha256(b"m\0t").hexdigest()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(vectors.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [pytest.approx(0.5**0.5), 0.0]


@pytest.mark.parametrize("word,want", [("torneado", "torn"), ("rápidamente", "rapid"), ("canciones", "cancion"), ("niños", "niñ"), ("comiendo", "com"), ("chicas", "chic"), ("habitación", "habit"), ("leyes", "ley"), ("circulación", "circul"), ("vehículos", "vehicul")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_spanish_lexemes(spark):
    assert one(spark, "Los vehículos de la circulación", text.spanish_lexemes) == ["vehicul", "circul"]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40))
def test_stem_never_grows_or_fails(word):
    assert len(stem(word)) <= len(word) + 2
    assert unicodedata.normalize("NFC", stem("casas")) == "cas"
