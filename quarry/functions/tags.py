"""Tag predicates: a record carries a flat ``array<string>`` of ``key:value`` tags.

A filter is a list of required tags (all must be present); a list of filters
is OR-ed. Empty filters are skipped and no filter at all means "everything".
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_TAG = "__document_id"


def tag(key: str, value: str) -> str:
    return f"{key}:{value}"


def document_tag(document_id: str) -> str:
    return tag(DOCUMENT_TAG, document_id)


def tags_contain_all(required: Iterable[str], col: str | Column = "tags") -> Column:
    """True when every required tag is present (``tags @> required``)."""
    req = [r for r in required]
    if not req:
        return F.lit(True)
    tags = F.col(col) if isinstance(col, str) else col
    return F.coalesce(
        F.size(F.array_except(F.array(*[F.lit(r) for r in req]), tags)) == 0,
        F.lit(False),
    )


def tags_filter(filters: Iterable[Iterable[str] | Mapping[str, str]] | None,
                col: str | Column = "tags") -> Column:
    """OR across filters, AND inside each. Mappings become ``key:value`` tags."""
    parts = []
    for flt in filters or []:
        req = [tag(k, v) for k, v in flt.items()] if isinstance(flt, Mapping) else list(flt)
        if req:
            parts.append(tags_contain_all(req, col))
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a | b, parts)


def tags_to_pairs(m: str | Column) -> Column:
    """``map<string,string>`` -> ``array<string>`` of ``key:value``."""
    m = F.col(m) if isinstance(m, str) else m
    return F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"]))
