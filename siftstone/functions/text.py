"""Text and identity functions as Column expressions; all run in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_name(c: Column) -> Column:
    """Lower-case name with collapsed white space."""
    return F.lower(collapse(c))


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 1)


def count_words(c: Column) -> Column:
    """Words by white space, 0 for blank text."""
    return F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(strip(c), r"(?U)\s+")))


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts, joined by line breaks; nulls count as empty."""
    payload = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, length))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 16))


def chunk_id(document: Column, page: Column, index: Column, text: Column) -> Column:
    return short_id("chunk_", document, page, index, text)


def entity_id(document: Column, chunk: Column, name: Column, kind: Column, subtype: Column, description: Column) -> Column:
    return short_id("entity_", document, chunk, strip(name), strip(kind), F.coalesce(strip(subtype), F.lit("")), strip(description))


def relation_id(document: Column, chunk: Column, source: Column, target: Column, kind: Column, name: Column, description: Column) -> Column:
    return short_id("relation_", document, chunk, source, target, strip(kind), strip(name), strip(description))


def merged_id(prefix: str, name: Column, members: Column) -> Column:
    """Id of a merged fact: its name, then the members' ids in order."""
    return short_id(prefix, strip(name), F.array_join(F.array_sort(members), "\n"))


def edge_id(source: Column, target: Column) -> Column:
    return short_id("", F.lit("edge"), source, target, length=24)


def contains_ignoring_case(c: Column, query: str, escape: bool = False) -> Column:
    """LIKE %query% without regard to case; wildcards of the query stay live unless escape."""
    if escape:
        return F.contains(F.lower(c), F.lit(query.lower()))
    return F.lower(c).like(f"%{query.lower()}%")


def ellipsis(c: Column, limit: int = 280) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("...")))


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"\|", r"\\|"), r"\r?\n", " ")


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def first_object(c: Column) -> Column:
    """The outermost {...} of a model's reply, without thinking blocks and code fences."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?m)^```[a-zA-Z]*\s*$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def matches(columns: Sequence[tuple[Column, object]]) -> Column:
    """All equal; a null value matches null, no conditions match all."""
    return functools.reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v)) for c, v in columns], F.lit(True))
