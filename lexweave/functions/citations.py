"""Drafts, closed citations and decisions as column expressions.

Columns: ``sources`` is array<struct<ref, texto>> in the order offered;
``citations`` is array<struct<n, quote, segmento>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEAST_QUOTE, fit_budget, fold_for_compare, segments, strip

# Marks of a draft, reasons, outcomes and limits.
ANSWER_MARK, CITATIONS_MARK = "RESPUESTA", "CITAS"
CANNOT_ANSWER = "NO PUEDO RESPONDER"
NO_CITATIONS, OUT_OF_RANGE, SEGMENT_OUT_OF_RANGE = "sin_citas", "fuera_de_rango", "segmento_fuera_de_rango"
EMPTY_QUOTE, SHORT_QUOTE, NOT_LITERAL, NOT_RELEVANT = "quote_vacio", "quote_demasiado_corto", "quote_no_literal", "sin_relevancia"
ANSWER, RETRY, ABSTAIN = "responder", "reintentar", "abstenerse"
LEAST_RELEVANCE, MOST_RETRIES = 0.10, 2
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
QUOTE_PAIRS = (("«", "»"), ("“", "”"), ('"', '"'), ("'", "'"))
HOLE_LINE = r"\A\[\[REF:(\d+)\]\](?U:\s)*(.*)\z"
SEGMENT_MARK = r"\A[§S](?U:\s)*(\d+)(?U:\s)*\z"


def unquote(x: Column) -> Column:
    """Without outer white space and one outer pair of quotation marks."""
    bare = strip(x)
    out = F.when(F.lit(False), bare)
    for left, right in QUOTE_PAIRS:
        out = out.when(bare.startswith(left) & bare.endswith(right) & (F.length(bare) >= 2), strip(bare.substr(F.lit(2), F.length(bare) - 2)))
    return out.otherwise(bare)


def split_draft(draft: Column) -> Column:
    """struct(prose, lines): the answer's text, and the lines of its citations (null if the draft has no such block)."""
    lines = F.split(draft, LINE_BREAK, -1)
    bare = F.transform(lines, strip)
    at = F.array_position(bare, CITATIONS_MARK).cast("int")
    after = F.slice(bare, at + 1, F.greatest(F.size(bare) - at, F.lit(0)))
    turn = F.array_position(after, ANSWER_MARK).cast("int")
    zone = F.when(turn > 0, F.slice(after, F.lit(1), F.greatest(turn - 1, F.lit(0)))).otherwise(after)
    rest = F.slice(lines, at + turn + 1, F.greatest(F.size(lines) - at - turn, F.lit(0)))
    prose = F.when(turn > 0, rest).otherwise(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return F.when(at > 0, F.struct(strip(F.array_join(prose, "\n")).alias("prose"), zone.alias("lines"))).otherwise(F.struct(strip(draft).alias("prose"), F.lit(None).cast("array<string>").alias("lines")))


def parse_citations(lines: Column, sources: Column) -> Column:
    """The citations in a draft's lines. ``§m`` copies segment m of its source; what can't be copied has an empty quote."""

    def one(line: Column) -> Column:
        n = F.regexp_extract(line, HOLE_LINE, 1).try_cast("int")
        tail = strip(F.regexp_extract(line, HOLE_LINE, 2))
        m = F.regexp_extract(tail, SEGMENT_MARK, 1).try_cast("int")
        pieces = segments(F.get(sources, n - 1)["texto"])
        return F.struct(n.alias("n"), F.when(m.isNull(), unquote(tail)).otherwise(F.coalesce(F.get(pieces, m - 1), F.lit(""))).alias("quote"), m.alias("segmento"))

    none = F.expr("cast(array() as array<struct<n:int,quote:string,segmento:int>>)")
    return F.coalesce(F.transform(F.filter(lines, lambda x: x.rlike(HOLE_LINE)), one), none)


def resolve_hole(n: Column, sources: Column) -> Column:
    """The reference of source ``n``; null outside 1..number of sources."""
    return F.when(n.between(1, F.size(sources)), F.get(sources, n - 1)["ref"])


def citation_reason(n: Column, segment: Column, n_sources: Column, n_segments: Column, quote: Column, text: Column) -> Column:
    """Why one citation is rejected, or null; ``quote`` and ``text`` are folded for comparison."""
    return (
        F.when(~F.coalesce(n.between(1, n_sources), F.lit(False)), OUT_OF_RANGE)
        .when(segment.isNotNull() & ~F.coalesce(segment.between(1, n_segments), F.lit(False)), SEGMENT_OUT_OF_RANGE)
        .when(quote == "", EMPTY_QUOTE)
        .when(F.length(quote) < LEAST_QUOTE, SHORT_QUOTE)
        .when(~F.coalesce(text.contains(quote), F.lit(False)), NOT_LITERAL)
    )


def decide(ok: Column, retries: Column, has_sources: Column, relevance: Column) -> Column:
    """Answer, retry or abstain after one verdict; a null relevance was not measured; negative retries fail."""
    return (
        F.when(retries < 0, F.raise_error(F.lit("negative retries")).cast("string"))
        .when(~has_sources, ABSTAIN)
        .when(relevance < LEAST_RELEVANCE, ABSTAIN)
        .when(ok, ANSWER)
        .when(retries < MOST_RETRIES, RETRY)
        .otherwise(ABSTAIN)
    )


def says_cannot(draft: Column) -> Column:
    return F.upper(draft).contains(CANNOT_ANSWER)


def source_blocks(sources: Column) -> Column:
    """The sources as shown to the generator: numbered, in numbered segments within the budget."""
    shown = lambda s: F.array_join(F.transform(fit_budget(segments(s["texto"])), lambda t, j: F.concat(F.lit("("), (j + 1).cast("string"), F.lit(") "), t)), " ")
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), shown(s))), "\n\n")


def plain_blocks(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["texto"])), "\n\n")


def render_prompt(template: str, question: Column, blocks: Column) -> Column:
    """A template without its front matter, its placeholders filled in."""
    body = template.split("---\n", 2)[2] if template.startswith("---\n") and template.count("---\n") >= 2 else template
    filled = F.replace(F.replace(F.lit(body), F.lit("{fuentes}"), F.lit("\x00")), F.lit("{pregunta}"), question)
    return F.replace(filled, F.lit("\x00"), blocks)


def sse(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))
