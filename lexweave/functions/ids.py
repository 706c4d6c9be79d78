"""Content-addressed identities."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_content


def doc_id(source_uri: Column) -> Column:
    return F.substring(F.sha2(source_uri, 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(normalize_content(content), 256)


@F.arrow_udf(T.StringType())
def _blake(seeds: pa.Array) -> pa.Array:
    return pa.array([None if s is None else hashlib.blake2b(s.encode(), digest_size=16).hexdigest() for s in seeds.to_pylist()], pa.string())


def chunk_id(doc: Column, content: Column, occurrence: Column) -> Column:
    """Position is not part of it, so an inserted paragraph renames no other chunk."""
    return _blake(F.concat(doc, content, occurrence.cast("string")))


def recording_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.char(F.lit(0)), text), 256)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
