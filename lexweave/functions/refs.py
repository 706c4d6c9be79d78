"""References to norms, articles and paragraphs: ``norm[#art<designator>[.<paragraph>]]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DASHES, bound, nfkc, strip

#: Match levels, from coarse to fine.
NORM, ARTICLE, PARAGRAPH = 0, 1, 2

# The canonical forms of a norm, a designator and a paragraph.
NORM_FORM = r"\A[A-Za-z]+-\d+/\d{4}\z"
DESIGNATOR_FORM = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"
PARAGRAPH_FORM = r"\A[a-z0-9]+(?:\.[a-z0-9]+)*\z"
ARTICLE_MARK = r"\A(?:art[íi]culo|art)\.?"


def normalize_ref(raw: Column, ascii_only: bool = False) -> Column:
    """The canonical spelling of a reference, whatever it refers to; ``ascii_only`` skips NFKC."""
    plain = strip(F.translate(raw if ascii_only else nfkc(raw), DASHES, "-" * len(DASHES)))

    def spelled(text: Column) -> Column:
        norm = F.regexp_replace(strip(F.substring_index(text, "#", 1)), r"(?U)\s+", "-")
        tail = lambda rest: F.when(rest.rlike(ARTICLE_MARK), F.concat(F.lit("#art"), F.regexp_replace(F.regexp_replace(rest, ARTICLE_MARK, ""), r"(?U)\s+", ""))).otherwise(F.concat(F.lit("#"), F.regexp_replace(rest, r"(?U)\s+", "")))
        rest = F.lower(F.regexp_extract(text, r"(?s)\A[^#]*#(.*)\z", 1))
        return F.when(text.contains("#"), F.concat(norm, bound(rest, tail))).otherwise(norm)

    return bound(F.regexp_replace(F.regexp_replace(plain, r"(?U)\s*#\s*", "#"), r"(?U)\s*\.\s*", "."), spelled)


def parse_ref(raw: Column, ascii_only: bool = False) -> Column:
    """struct(norma, articulo, apartado, error); where error is set the others are null."""

    def parts(text: Column) -> Column:
        rest = F.regexp_extract(text, r"(?s)\A[^#]*#(.*)\z", 1)
        designator = F.substring(rest, 4, 1 << 30)
        paragraph = F.regexp_extract(designator, r"(?s)\A[^.]*\.(.*)\z", 1)
        return F.struct(text.alias("text"), F.substring_index(text, "#", 1).alias("norm"), rest.alias("rest"), designator.alias("designator"), F.substring_index(designator, ".", 1).alias("article"), paragraph.alias("paragraph"), text.contains("#").alias("has"), designator.contains(".").alias("dotted"))

    def judged(p: Column) -> Column:
        text, norm, rest, designator, article, paragraph, has, dotted = (p[c] for c in ("text", "norm", "rest", "designator", "article", "paragraph", "has", "dotted"))
        error = (
            F.when(text.isNull() | (text == ""), "empty")
            .when(F.length(text) - F.length(F.replace(text, F.lit("#"), F.lit(""))) > 1, "several references")
            .when(~norm.rlike(NORM_FORM), "unknown norm")
            .when(~has, F.lit(None).cast("string"))
            .when(~rest.startswith("art"), "no article mark")
            .when(designator == "", "mark without designator")
            .when(dotted & (paragraph == ""), "empty paragraph")
            .when(article == "", "empty article")
            .when(~article.rlike(DESIGNATOR_FORM), "designator not canonical")
            .when(dotted & ~paragraph.rlike(PARAGRAPH_FORM), "paragraph not canonical")
        )
        return bound(error, lambda e: F.struct(F.when(e.isNull(), norm).alias("norma"), F.when(e.isNull() & has, article).alias("articulo"), F.when(e.isNull() & has & dotted, paragraph).alias("apartado"), e.alias("error")))

    return bound(bound(normalize_ref(raw, ascii_only), parts), judged)


def parse_ref_strict(raw: Column) -> Column:
    """As ``parse_ref``, but a reference that can't be read fails the query."""
    parsed = parse_ref(raw)
    return F.when(parsed["error"].isNotNull(), F.raise_error(F.concat(F.lit("reference: "), parsed["error"], F.lit(": "), F.coalesce(raw, F.lit("null"))))).otherwise(parsed)


def format_ref(norm: Column, article: Column, paragraph: Column) -> Column:
    """The text of a reference; null with a null norm. A paragraph without an article is left out."""
    tail = F.when(article.isNotNull(), F.concat(F.lit("#art"), article, F.coalesce(F.concat(F.lit("."), paragraph), F.lit(""))))
    return F.concat(norm, F.coalesce(tail, F.lit("")))


def legal_ref(norm: Column, article: Column, paragraph: Column, ref: Column) -> Column:
    """The stored reference: built from its parts, else the given one."""
    return F.coalesce(F.concat(norm, F.coalesce(F.concat(F.lit("#art"), article), F.lit("")), F.coalesce(F.concat(F.lit("."), paragraph), F.lit(""))), ref)


def ref_level(text: Column) -> Column:
    """0 for a norm, 1 for an article, 2 for a paragraph, by the form of a canonical reference."""
    return F.when(~text.contains("#"), NORM).when(F.substring_index(text, "#", -1).contains("."), PARAGRAPH).otherwise(ARTICLE)


def article_of(text: Column) -> Column:
    """A canonical reference without its paragraph."""
    return F.regexp_replace(text, r"(#[^.]*)\..*\z", "$1")


def refs_match(a: Column, b: Column, level: Column | int) -> Column:
    """Whether two canonical references agree down to ``level``; one that lacks the level does not."""
    level = F.lit(level) if isinstance(level, int) else level
    deep = lambda n: (ref_level(a) >= n) & (ref_level(b) >= n)
    norms = F.substring_index(a, "#", 1) == F.substring_index(b, "#", 1)
    articles = deep(ARTICLE) & (article_of(a) == article_of(b))
    same = F.when(level == NORM, norms).when(level == ARTICLE, articles).otherwise(deep(PARAGRAPH) & (a == b))
    return F.coalesce(same, F.lit(False))


def cites(citation: Column, relevant: Column) -> Column:
    """Whether a citation falls within a relevant reference: at that one's own level, finer is fine."""
    return refs_match(citation, relevant, ref_level(relevant))
