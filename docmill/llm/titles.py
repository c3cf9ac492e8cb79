"""File names as titles: what two names must share to be the same title.

File type, letter case, separators, word order and marks of a copy or version
are left out. Words that hold a digit (years, quarters, numbers) must be
equal; the other words must pair up within ``MAX_EDITS`` edits (insertion,
deletion, substitution or transposition of neighbours) in all. A word under
``LONG_WORD`` letters may hold one of them, or two where it has five letters
and at least two other words are the same: two copies of one title, each with
an edit of its own, differ by two.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits that all words of two names may differ by together; in words under LONG_WORD letters one at most (see above).
MAX_EDITS, LONG_WORD = 2, 6

# Words that mark a copy or version, and names that say nothing.
MARKS = ("copy", "copie", "copia", "kopie", "final", "draft", "duplicate")
GENERIC = ("untitled", "unbenannt", "document", "doc", "file", "scan", "image", "img", "new", "notes", "note", "temp", "tmp", "test", "page", "page1", "sheet", "presentation", "unnamed", "noname", "null", "none", "copy", "final", "draft")
EXTENSION = re.compile(r"\.(?:pdf|docx?|txt|md|odt|rtf|xlsx?|pptx?|csv|html?|json|gdoc|pages)$", re.I)
VERSION = re.compile(r"^(?:v|ver|version|rev|r)\d+$")
COUNTER = re.compile(r"\(\s*\d+\s*\)")
SPLIT = re.compile(r"[\W_]+")


def edits(a: str, b: str, most: int = 9) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@functools.lru_cache(maxsize=200_000)
def is_mark(w: str) -> bool:
    """Whether a word is a mark of a copy or version, one edit allowed."""
    return bool(VERSION.match(w)) or any(edits(w, m, 1) <= 1 for m in MARKS)


def canonical(name: str | None) -> str | None:
    """The words of a title in order of code points, those with a digit after a bar; None for a null, blank or generic name."""
    if name is None:
        return None
    s = unicodedata.normalize("NFKC", name).strip()
    while EXTENSION.search(s):
        s = EXTENSION.sub("", s).strip()
    s = COUNTER.sub(" ", s.casefold())
    words = [w for w in SPLIT.split(s) if w]
    out = []
    for i, w in enumerate(words):
        if is_mark(w):
            continue
        if i and w[:1] == "o" and is_mark(words[i - 1]) and edits(w, "of", 1) <= 1:
            continue
        out.append(w)
    letters = [w for w in out if not any(c.isdigit() for c in w)]
    if not letters or all(w in GENERIC for w in letters):
        return None
    return " ".join(sorted(letters)) + "|" + " ".join(sorted(w for w in out if w not in letters))


def same_words(a: str, b: str) -> bool:
    """Whether the words without digits pair up."""
    x, y = a.split(), b.split()
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    if len(x) != len(y):
        return False
    if len(x) > MAX_EDITS:
        return False
    known = len(a.split()) - len(x) >= 2
    return any(sum(_word_edits(u, v, known) for u, v in zip(x, p)) <= MAX_EDITS for p in permutations(y))


def _word_edits(u: str, v: str, known: bool) -> int:
    d = edits(u, v, MAX_EDITS)
    size = max(len(u), len(v))
    return d if d <= (0 if size <= 3 else 1 if size < LONG_WORD - known else MAX_EDITS) else MAX_EDITS + 1


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical)


@F.pandas_udf(T.BooleanType())
def same_words_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_words(x, y) for x, y in zip(a, b)], dtype=bool)
