"""Labels, trace context and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that the stored label text replaces by escapes.
ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def labels_json(labels: Column) -> Column:
    """Label map as JSON text with sorted keys; null when there are no labels."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))
    for plain, escape in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return F.when(F.size(labels) > 0, text)


def label(labels: Column, name: str) -> Column:
    return F.try_element_at(labels, F.lit(name))


def trace_id(traceparent: Column) -> Column:
    """Trace id of a ``version-traceid-spanid-flags`` header; null when malformed or all zero."""
    found = F.regexp_extract(traceparent, "^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}$", 1)
    return F.when((found != "") & (found != "0" * 32), found)


def span_id(traceparent: Column) -> Column:
    found = F.regexp_extract(traceparent, "^[0-9a-f]{2}-[0-9a-f]{32}-([0-9a-f]{16})-[0-9a-f]{2}$", 1)
    return F.when((found != "") & (found != "0" * 16), found)


def stable_id(*parts: Column) -> Column:
    """UUID-shaped identifier that depends only on ``parts``, so a replay gives the same one."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])
