"""Scalar expressions that several operators share. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(c: Column, f) -> Column:
    """f(c) with c evaluated once a row, also where f uses it inside another lambda."""
    return F.element_at(F.transform(F.array(c), f), 1)


BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (trim() only knows blanks)."""
    return F.regexp_replace(c, BLANKS, "")


def entity_key(c: Column) -> Column:
    return F.lower(strip(c))


def chunk_id(doc_id: Column, text: Column) -> Column:
    """"chunk-" and 12 hex digits of the content within its document."""
    key = F.when(F.coalesce(doc_id, F.lit("")) == "", text).otherwise(F.concat(doc_id, F.lit(":"), text))
    return F.concat(F.lit("chunk-"), F.substring(F.md5(key), 1, 12))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def low_end(a: Column, b: Column) -> Column:
    return F.least(a, b)


def high_end(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def strip_fence(c: Column) -> Column:
    """A model's reply without a code fence around it."""
    s = strip(c)
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(s)


def citation_refs(c: Column) -> Column:
    """Numbers of the [n] marks, in order of appearance."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[\d+\]", "")


def json_list(c: Column) -> Column:
    """A JSON array of strings; null where it is broken."""
    return F.from_json(c, "array<string>")
