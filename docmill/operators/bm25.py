"""Phrase search with BM25 over several text columns, per namespace."""

from __future__ import annotations

import functools
import itertools
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import let

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("text", "keywords", "expanded_keywords", "summary")


#: What lies between tokens: everything but letters, numbers and private characters of any script.
BETWEEN = r"[^\p{L}\p{N}\p{Co}]+"


@functools.cache
def accents() -> tuple[str, str]:
    """Characters and what they become: small Latin letters with one accent lose it; combining accents come after them and are dropped."""
    pairs = []
    for i in range(0x80, 0x2000):
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) == 2 and "a" <= d[0] <= "z" and unicodedata.combining(d[1]):
            pairs.append((chr(i), d[0]))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Small letters without accents; null as an empty text."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *accents())


def tokens(c: Column) -> Column:
    """Runs of letters and digits, letter case and accents of Latin letters folded."""
    return F.filter(F.split(folded(c), BETWEEN), lambda x: x != "")


def phrase_tokens(query: str) -> list[str]:
    a, b = accents()
    low = query.lower().translate({ord(x): b[i] if i < len(b) else None for i, x in enumerate(a)})
    return ["".join(g) for ok, g in itertools.groupby(low, lambda ch: unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co") if ok]


def _occurrences(toks: Column, phrase: list[str]) -> Column:
    n = len(phrase)
    at = F.sequence(F.lit(1), F.size(toks) - (n - 1))
    hit = lambda i: _all([F.element_at(toks, (i + j).cast("int")) == F.lit(p) for j, p in enumerate(phrase)])
    return F.when(F.size(toks) >= n, F.size(F.filter(at, hit))).otherwise(F.lit(0))


def _counts(c: Column, phrase: list[str]) -> Column:
    """(tokens, occurrences of the phrase) of a column.

    Each token is put between blanks of its own, so that occurrences of a
    phrase cannot share a blank; what is left after taking the phrase out tells
    how often it stood there. All of that is compiled code. A phrase that can
    overlap itself ("a a") is counted position by position instead.
    """
    n = len(phrase)
    if any(phrase[k:] == phrase[: n - k] for k in range(1, n)):
        return let(tokens(c), lambda t: F.struct(F.size(t).alias("len"), _occurrences(t, phrase).alias("f")))
    plain = F.trim(F.regexp_replace(folded(c), BETWEEN, " "))
    spaced = F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" ")))
    p = " " + "  ".join(phrase) + " "

    def count(s: Column) -> Column:
        size = ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")
        return F.struct(size.alias("len"), ((F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)).cast("int").alias("f"))

    # bound by a lambda, else every later use of a count would run the expressions again
    return let(spaced, count)


def _all(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def postings(chunks: DataFrame) -> DataFrame:
    """Inverted index (namespace, term, chunk_id, col, positions), for a table that is searched often; partition it by a hash of the term."""
    u = None
    for c in COLUMNS:
        one = chunks.select("namespace", "chunk_id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term"))
        u = one if u is None else u.unionByName(one)
    return u.groupBy("namespace", "term", "chunk_id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def bm25_phrase(chunks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(namespace, chunk_id, score) of chunks that hold the query as one phrase within a column; lower is better. One scan; only counts are shuffled."""
    phrase = phrase_tokens(query)
    if not phrase:
        return chunks.select("namespace", "chunk_id", F.lit(0.0).alias("score")).where(F.lit(False))
    rows = chunks.select("namespace", "chunk_id", *[_counts(F.col(c), phrase).alias(f"c_{c}") for c in COLUMNS])
    add = lambda k: reduce(lambda a, b: a + b, [F.col(f"c_{c}.{k}") for c in COLUMNS])
    rows = rows.select("namespace", "chunk_id", add("len").alias("len"), add("f").alias("f"))
    stats = rows.groupBy("namespace").agg(F.count("*").alias("total"), F.count_if(F.col("f") > 0).alias("with_phrase"), F.avg("len").alias("avg"))
    idf = F.log((F.col("total") - F.col("with_phrase") + 0.5) / (F.col("with_phrase") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    score = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    out = rows.where("f > 0").join(F.broadcast(stats), "namespace").select("namespace", "chunk_id", F.round(score, 6).alias("score"))
    return out if limit is None else out.orderBy("score", "chunk_id").limit(limit)
