"""Text normalisation, analysis and segmentation as column expressions.

Unicode normal forms have no built-in function and go through Arrow functions;
all else stays in the JVM. ``(?U)`` makes Java's classes follow Unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dash code points that count as a hyphen, and quotation marks with what they fold to.
DASHES = "‐‑‒–—―−"
QUOTES = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "‚": "'"}
#: Lengths in characters below which a segment is no quotation, and at which one is capped.
LEAST_QUOTE, LONGEST_SEGMENT, SOURCE_BUDGET = 12, 300, 500
#: Fixed value: where a sentence ends. A stop after a digit numbers something and ends nothing.
SENTENCE_END = r'(?<=[.:;])(?<![0-9][.:;])(?U:\s)+(?=[¿¡"«A-ZÁÉÍÓÚÑ\d])|\n+'


def _normal(form: str):
    @F.arrow_udf(T.StringType())
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return normal


nfc, nfkc = _normal("NFC"), _normal("NFKC")


@F.arrow_udf(T.StringType())
def _bare(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts.to_pylist()], pa.string())


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def squeeze(x: Column) -> Column:
    """Runs of white space become one space, and none is left at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_content(x: Column) -> Column:
    """For identity: NFC and squeezed white space."""
    return squeeze(nfc(x))


def fold_for_compare(x: Column) -> Column:
    """For comparison: NFKC, one kind of quote and dash, squeezed white space."""
    return squeeze(F.translate(nfkc(x), "".join(QUOTES) + DASHES, "".join(QUOTES.values()) + "-" * len(DASHES)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pa.Array) -> pa.Array:
    return pa.array([None if row is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in row] for row in lists.to_pylist()], pa.list_(pa.string()))


def fold_each_for_compare(xs: Column) -> Column:
    """``fold_for_compare`` of each text of an array."""
    return F.transform(_nfkc_each(xs), lambda x: squeeze(F.translate(x, "".join(QUOTES) + DASHES, "".join(QUOTES.values()) + "-" * len(DASHES))))


def strip_accents(x: Column) -> Column:
    """For headings: no accents, lower case, no outer white space."""
    return strip(F.lower(_bare(x)))


def query_terms(x: Column) -> Column:
    """The words of a question, in order, lower case. An empty array means there is nothing to search for."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))


def simple_lexemes(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    from .stemmer import stem

    return pa.array([None if row is None else [stem(t) for t in row] for row in tokens.to_pylist()], pa.list_(pa.string()))


def spanish_lexemes(x: Column) -> Column:
    """Words without accents, then without stop words, stemmed: the order of the reference's text search.

    As there, stop words that the list has only with an accent (``más``) stay.
    """
    from pyspark.ml.feature import StopWordsRemover

    stop = F.array(*map(F.lit, StopWordsRemover.loadDefaultStopWords("spanish")))
    return _stemmed(F.filter(simple_lexemes(_bare(F.lower(x))), lambda t: ~F.array_contains(stop, t)))


def tokens_of_stream(x: Column) -> Column:
    """A text cut into chunks that join back to it: each word with the white space after it."""
    return F.regexp_extract_all(x, F.lit(r"(?U)\S+\s*|\s+"), F.lit(0))


def wrap(x: Column, width: int) -> Column:
    """A text's lines, each wrapped at ``width`` characters between words; a longer word is cut."""
    return F.array_join(F.flatten(F.transform(F.split(x, "\n", -1), lambda line: _packed(line, width))), "\n")


def _packed(sentence: Column, longest: int = LONGEST_SEGMENT) -> Column:
    """A sentence in pieces of at most ``longest`` characters, cut between words, or inside a longer word."""
    n = F.lit(longest)
    cut = lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / n).cast("int")), lambda i: F.substring(w, i * n + 1, n)))
    words = F.flatten(F.transform(F.split(sentence, " ", -1), cut))

    def add(pieces: Column, word: Column) -> Column:
        last = F.element_at(pieces, -1)
        room = (F.length(last) == 0) | (F.length(last) + 1 + F.length(word) <= n)
        joined = F.when(F.length(last) == 0, word).otherwise(F.concat(last, F.lit(" "), word))
        return F.when(room, F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(joined))).otherwise(F.concat(pieces, F.array(word)))

    return F.when(F.length(sentence) <= n, F.array(sentence)).otherwise(F.aggregate(words, F.array(F.lit("")), add))


def segments(x: Column) -> Column:
    """The segments of a text that can be cited: sentences, none longer than the cap, short ones joined to their neighbours."""
    none = F.expr("cast(array() as array<string>)")
    sentences = F.filter(F.transform(F.split(x, SENTENCE_END, -1), strip), lambda s: s != "")
    pieces = F.flatten(F.transform(sentences, lambda s: _packed(s)))

    def join(done: Column, piece: Column) -> Column:
        short = (F.size(done) > 0) & (F.length(F.try_element_at(done, F.lit(-1))) < LEAST_QUOTE)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), piece)))
        return F.when(short, grown).otherwise(F.concat(done, F.array(piece)))

    joined = F.aggregate(pieces, none, join)
    tail = (F.size(joined) > 1) & (F.length(F.try_element_at(joined, F.lit(-1))) < LEAST_QUOTE)
    merged = F.concat(F.slice(joined, 1, F.greatest(F.size(joined) - 2, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(joined, F.lit(-2)), F.try_element_at(joined, F.lit(-1)))))
    return F.when(tail, merged).otherwise(joined)


def fit_budget(pieces: Column, budget: int = SOURCE_BUDGET) -> Column:
    """The leading segments whose lengths (and a space each) stay within the budget; always the first."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | ((acc["used"] + F.length(s) > budget) & (acc["n"] > 0))
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + F.length(s) + 1).alias("used"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    return F.slice(pieces, F.lit(1), F.aggregate(pieces, start, step)["n"])
