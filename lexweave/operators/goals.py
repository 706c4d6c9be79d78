"""Values of report documents by path, and nested reports from flat names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def select_path(document: Column, selector: str) -> Column:
    """The value at a dotted path of a JSON text; ``list[id=x]`` is the list's first element with that id. What is missing is null."""
    at = document
    for part in selector.split("."):
        m = re.fullmatch(r"([^\[\]]+)\[(\w+)=([^\]]*)\]", part)
        at = F.get_json_object(at, f"$.{m[1] if m else part}")
        if m:
            at = F.get(F.filter(F.from_json(at, "array<string>"), _has(m[2], m[3])), F.lit(0))
    return at


def _has(key: str, wanted: str):
    return lambda x: F.get_json_object(x, f"$.{key}") == wanted


def nest(values: dict[str, Column]) -> Column:
    """A struct of structs from columns by dotted name."""
    tree: dict = {}
    for name, column in values.items():
        *path, last = name.split(".")
        at = tree
        for p in path:
            at = at.setdefault(p, {})
        at[last] = column

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(node.items())])

    return build(tree)
