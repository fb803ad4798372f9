"""Content ids: name-based UUIDs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Namespace of all content ids (fixed value).
NAMESPACE = "28652829-7950-5833-b09f-b4df7fd465e7"
#: Separator of an id's parts, and of the entries of a list among them (fixed values).
PART, ENTRY = "\x1f", "/"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a string; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    dash = F.lit("-")
    return F.concat(F.substring(h, 1, 8), dash, F.substring(h, 9, 4), dash, F.lit("5"), F.substring(h, 14, 3), dash, variant, F.substring(h, 18, 3), dash, F.substring(h, 21, 12))


def content_id(*parts: Column) -> Column:
    """Id of the parts in order; any null part gives null."""
    return uuid5(F.md5(F.encode(F.concat(*[x for p in parts for x in (F.lit(PART), p.cast("string"))][1:]), "UTF-8")))


def paragraph_id(text: Column, path: Column, page: Column) -> Column:
    return content_id(F.lit("paragraph"), text, F.array_join(path, ENTRY), page)


def section_id(title: Column, level: Column, path: Column) -> Column:
    return content_id(F.lit("section"), title, level, F.array_join(path, ENTRY))
