"""Texts that look the same but are written with other characters.

1. Look-alike pairs of strings come from the Unicode properties of the code
   points in use (full-width and half-width forms, ligatures, blanks, invisible
   characters, canonical decompositions) and from a table of letters of
   different scripts with one shape. Union-find over strings and code points
   makes them transitive classes.
2. All code points and all strings of the classes are counted over the whole
   corpus; each class is represented by its most frequent member (invisible
   characters by nothing).
3. Texts are decomposed, rewritten leftmost-longest by an Aho-Corasick automaton over the
   other members, and composed again.

Null texts stay null. An empty text stays empty. Differences that are seen
(accents, digits, letter case, other punctuation, number of blanks) stay. Each
row is rewritten alone, so repeated rows give repeated rows. Whole texts are
used.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.storage import materialize

# Letters of one shape in Latin and in Cyrillic, Greek and other scripts.
SHAPES = (
    ("A", "АΑ"), ("B", "ВΒ"), ("C", "СϹ"), ("E", "ЕΕ"), ("F", "Ϝ"), ("H", "НΗ"), ("I", "ІΙӀ"), ("J", "ЈͿ"), ("K", "КΚK"), ("M", "МΜ"), ("N", "Ν"), ("O", "ОΟՕ"), ("P", "РΡ"), ("Q", "Ԛ"), ("S", "ЅՏ"), ("T", "ТΤ"), ("W", "Ԝ"), ("X", "ХΧ"), ("Y", "ΥҮ"), ("Z", "Ζ"), ("a", "а"), ("c", "сϲ"), ("d", "ԁ"), ("e", "е"), ("h", "һ"), ("i", "і"), ("j", "јϳ"), ("l", "ӏ"), ("o", "оοօ"), ("p", "р"), ("q", "ԛ"), ("s", "ѕ"), ("u", "ս"), ("v", "ѵ"), ("w", "ԝ"), ("x", "х"), ("y", "у"), ("y", "ү"), ("У", "Ꭹ"), ("Г", "Γ"), ("П", "Π"), ("Ф", "Φ"), ("Ω", "Ω"), ("µ", "μ"), ("-", "‐‑"), (";", ";"), ("·", "·"),
)
INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0}
#: Decompositions that leave the look as it is.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


class UnionFind:
    """Classes of strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def look_alikes(code_points: set[int]) -> UnionFind:
    """Classes over the given code points and the strings that they look like; strings are decomposed."""
    uf = UnionFind()
    for base, others in SHAPES:
        for o in others:
            uf.union(base, unicodedata.normalize("NFD", o) if unicodedata.normalize("NFD", o) != base else o)
    uf.union("\r\n", "\n")
    for cp in sorted(code_points | INVISIBLE):
        ch = chr(cp)
        d = unicodedata.decomposition(ch).split()
        if cp in INVISIBLE:
            uf.union("", ch)
        elif unicodedata.category(ch) == "Zs":
            uf.union(" ", ch)
        elif d and d[0] in SAME_LOOK or 0xFB00 <= cp <= 0xFB06:
            uf.union(ch, unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch)))
    return uf


@functools.cache
def longer_members() -> tuple[str, ...]:
    """All members of classes with more than one code point that come from any code point of the basic plane."""
    return tuple(sorted({m for ms in look_alikes({cp for cp in range(0x10000) if not 0xD800 <= cp <= 0xDFFF}).classes().values() for m in ms if len(m) > 1}))


def count_strings(texts: DataFrame, strings: tuple[str, ...]) -> dict[str, int]:
    """Occurrences of every code point, and of the given longer strings, in decomposed texts. At most one row per code point and string and task is shuffled; the driver gets one row per code point and string."""

    def run(batches):
        n: dict[str, int] = {}
        bmp = np.zeros(0x10000, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if not t.isascii():
                    t = unicodedata.normalize("NFD", t)
                    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    for c in cp[cp > 0xFFFF].tolist():
                        n[chr(c)] = n.get(chr(c), 0) + 1
                    cp = cp[cp <= 0xFFFF]
                else:
                    cp = np.frombuffer(t.encode(), np.uint8)
                bmp[: (cp.max() + 1 if len(cp) else 0)] += np.bincount(cp, minlength=0)
                for s in strings:
                    if k := t.count(s):
                        n[s] = n.get(s, 0) + k
        at = np.flatnonzero(bmp)
        keys = [chr(c) for c in at.tolist()] + list(n)
        keep = [k for k in keys if not 0xD800 <= ord(k[0]) <= 0xDFFF]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array([int(bmp[ord(k)]) if len(k) == 1 and ord(k) < 0x10000 else n[k] for k in keep], pa.int64())], names=["s", "n"])

    return {r.s: r.n for r in texts.mapInArrow(run, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()}


class Rewriter:
    """Table of replacements and the automaton that finds them."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self._auto = None

    def __getstate__(self):
        return {"table": self.table, "_auto": None}

    @staticmethod
    def fit(counts: dict[str, int], uf: UnionFind) -> Rewriter:
        table = {}
        for members in uf.classes().values():
            rep = "" if "" in members else max(members, key=lambda m: (counts.get(m, 0), -len(m), [-ord(c) for c in m]))
            table |= {m: rep for m in members if m != rep}
        return Rewriter(table)

    @property
    def automaton(self):
        if self._auto is None:
            import ahocorasick

            self._auto = ahocorasick.Automaton()
            for k, v in self.table.items():
                self._auto.add_word(k, (len(k), v))
            self._auto.make_automaton()
        return self._auto

    def __call__(self, text: str) -> str:
        # A rewrite can bring new neighbours together (f, zero width, i), so it goes on until nothing changes. Each
        # replacement leads to its class's representative, which is never replaced itself, so every round that changes
        # the text leaves fewer strings to replace; a form seen before (two classes whose members overlap) ends it too.
        seen: set[str] = set()
        while text not in seen:
            seen.add(text)
            d = unicodedata.normalize("NFD", text) if not text.isascii() else text
            out, at = [], 0
            for end, (n, rep) in self.automaton.iter_long(d):
                out += [d[at : end + 1 - n], rep]
                at = end + 1
            new = "".join([*out, d[at:]])
            if not new.isascii():
                new = unicodedata.normalize("NFC", new)
            if new == text:
                break
            text = new
        else:
            text = min(seen)
        return text


def fit_rewriter(df: DataFrame, text_col: str) -> Rewriter:
    """Look-alike classes and their representatives from all texts of a table."""
    texts = df.select(F.col(text_col).alias("text")).where("text is not null")
    counts = count_strings(texts, longer_members())
    return Rewriter.fit(counts, look_alikes({ord(s) for s in counts if len(s) == 1}))


def rewrite(df: DataFrame, id_col: str, text_col: str, rewriter: Rewriter) -> DataFrame:
    """(id, text, canonical) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(rewriter)  # bounded by the code points in use
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        f = shared.value
        for batch in batches:
            out = [None if t is None else f(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["id", "text", "canonical"])

    return rows.mapInArrow(run, "id string, text string, canonical string")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): different texts of one canonical form. Groups of identical texts alone are never joined."""
    both = rewrite(df, id_col, text_col, fit_rewriter(df, text_col)).where("text is not null and id is not null")
    # 128 bits of each form, so that texts are not shuffled
    keys = materialize(both.select("id", F.unhex(F.md5("canonical")).alias("c"), F.unhex(F.md5("text")).alias("t")).distinct(), "forms")
    several = keys.groupBy("c").agg(F.count_distinct("t").alias("n")).where("n > 1").select("c")
    m = keys.join(several, "c", "left_semi")
    return m.withColumnRenamed("id", "a").withColumnRenamed("t", "ta").join(m.withColumnRenamed("id", "b").withColumnRenamed("t", "tb"), "c").where("ta <> tb").select("a", "b")

