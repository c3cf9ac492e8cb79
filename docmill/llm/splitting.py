"""Splitting oversized texts at topic boundaries (lexical cohesion).

From the start of a piece, every natural boundary between the smallest and the
largest allowed end is a candidate: ends of paragraphs, of lines and sentences,
and of clauses; words only where the window has none of these. At each
candidate the words of a sliding block before it are compared with those of
the block after it (cosine); a valley's depth is what the similarity falls
below the highest values on both sides. The cut is the deepest valley of the
window, its depth counted times the weight of its kind (``WEIGHTS``), the later
one on a tie. The next piece begins ``overlap`` tokens before the cut.

Null texts give no piece, an empty text one empty piece, a text within the
limit one piece. Rows repeated with the same id count once (the smallest text
and section). Where there is no boundary at all, a text is cut between
characters, never between a letter and its combining mark. Whole texts are
used whatever their length; the work per piece depends on the limit alone.
Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import once

#: Share of the limit that a piece has at least, where a boundary allows a choice.
LEAST_SHARE = 0.5
#: Words on each side of a candidate that are compared.
BLOCK = 45
#: By how much a valley at the end of a paragraph, a sentence or a clause counts, and the depth that each has at least: a sharp topic change inside a paragraph wins over a shallow one between two.
WEIGHTS, LEAST_DEPTH = (1.5, 1.0, 0.5), 0.05
_WORD = re.compile(r"[^\W_]{3,}")
_BOUNDARIES = (
    re.compile(r"\n\s*\n\s*"),
    re.compile(r"\n|(?<=[.!?…。！？])[\"'»”)\]]*\s+"),
    re.compile(r"(?<=[;:,])\s+"),
    re.compile(r"\s+"),
)


class CharMeasure:
    """A text's tokens are its code points divided by ``per_token``, rounded down."""

    def __init__(self, per_token: int = 4):
        self.per = per_token

    def count(self, text: str, a: int, b: int) -> int:
        return (b - a) // self.per

    def fit(self, text: str, a: int, limit: int) -> int:
        return min(len(text), a + self.per * limit + self.per - 1)

    def back(self, text: str, b: int, k: int) -> tuple[int, int]:
        """Earliest and latest start of the k tokens before b."""
        return max(0, b - self.per * k - self.per + 1), max(0, b - self.per * k)


class BpeMeasure:
    """Tokens of a public tokenizer's file (``.json`` of tokenizers); counts are those of the slice encoded alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True

    def _encode(self, s: str):
        return self.tok.encode(s, add_special_tokens=False)

    def count(self, text: str, a: int, b: int) -> int:
        return len(self._encode(text[a:b]).ids)

    def fit(self, text: str, a: int, limit: int) -> int:
        part = text[a : a + 40 * limit]
        ends = [e for _, e in self._encode(part).offsets]
        if len(ends) <= limit:
            return a + len(part) if a + len(part) == len(text) or not ends else a + max(ends)
        return a + max(ends[limit - 1], 1)

    def back(self, text: str, b: int, k: int) -> tuple[int, int]:
        lo = max(0, b - 40 * k)
        starts = [s for s, _ in self._encode(text[lo:b]).offsets]
        at = lo + (starts[-k] if k and len(starts) >= k else 0) if k else b
        return at, at


def _cohesion(text: str, cuts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Valley depth of each cut, from the words of text[lo:hi]."""
    at, ids, seen = [], [], {}
    for m in _WORD.finditer(text, lo, hi):
        at.append(m.start())
        ids.append(seen.setdefault(m.group().lower(), len(seen)))
    if len(ids) < 4:
        return np.zeros(len(cuts))
    pos = np.searchsorted(np.array(at), cuts)
    gaps = np.unique(np.concatenate([[0], pos, np.maximum(0, pos - BLOCK), np.minimum(len(ids), pos + BLOCK), [len(ids)]]))
    seg = np.searchsorted(gaps, np.arange(len(ids)), side="right")
    table = np.zeros((len(gaps) + 1, len(seen)), np.float32)
    np.add.at(table, (seg, np.array(ids)), 1)
    cum = np.cumsum(table, 0)
    row = lambda w: cum[np.searchsorted(gaps, w)]
    left, right = row(pos) - row(np.maximum(0, pos - BLOCK)), row(np.minimum(len(ids), pos + BLOCK)) - row(pos)
    norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    sim = np.divide((left * right).sum(1), norm, out=np.zeros(len(cuts), np.float32), where=norm > 0)
    # the nearest peaks on both sides: climb while the similarity does not fall
    n = len(sim)
    lp, rp = sim.copy(), sim.copy()
    for i in range(1, n):
        lp[i] = lp[i - 1] if sim[i - 1] >= sim[i] else sim[i]
    for i in range(n - 2, -1, -1):
        rp[i] = rp[i + 1] if sim[i + 1] >= sim[i] else sim[i]
    return np.round((lp - sim) + (rp - sim), 6)


def _hard(text: str, b: int, a: int) -> int:
    while b > a + 1 and b < len(text) and unicodedata.combining(text[b]):
        b -= 1
    return b


def split_text(text: str, limit: int, overlap: int, measure) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of each piece, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    out, start, core = [], 0, 0
    while True:
        most = measure.fit(text, start, limit)
        if most >= len(text):
            out.append((start, len(text), "end"))
            return out
        most = max(most, core + 1)
        least = core + int((most - core) * LEAST_SHARE)
        cut, kind = 0, "character"
        lo, hi = max(least - 8, core), min(len(text), most + 8)
        kinds: dict[int, int] = {}  # the best kind of each candidate; the boundary's white space stays with the piece before it
        for k, pattern in enumerate(_BOUNDARIES):
            if k == 3 and kinds:
                break
            for m in pattern.finditer(text, lo, hi):
                if least < m.end() <= most:
                    kinds.setdefault(m.end(), k)
        if kinds:
            cuts = np.array(sorted(kinds))
            of = np.array([kinds[c] for c in cuts.tolist()])
            depth = _cohesion(text, cuts, max(0, least - 12 * BLOCK), min(len(text), most + 12 * BLOCK)) if len(cuts) > 1 else np.zeros(1)
            worth = np.round((depth + LEAST_DEPTH) * np.array([*WEIGHTS, 1.0])[of], 6)
            best = len(cuts) - 1 - int(np.argmax(worth[::-1]))
            cut, kind = int(cuts[best]), ("paragraph", "sentence", "clause", "word")[of[best]]
        if not cut:
            cut = _hard(text, most, core)
        while cut > core + 1 and measure.count(text, start, cut) > limit:
            cut, kind = cut - 1, "character"  # a tokenizer may count a slice higher than its part of the whole
        out.append((start, cut, kind))
        early, late = measure.back(text, cut, overlap)
        nxt = late
        for x in range(late, early - 1, -1):
            if x and text[x - 1].isspace():
                nxt = x
                break
        start, core = max(nxt, out[-1][0] + 1), cut


SCHEMA = "id string, piece int, n_pieces int, section string, text string, n_tokens int, start_char int, end_char int, boundary string"


def split_oversized(df: DataFrame, id_col: str, text_col: str, section_col: str | None = None, limit: int = 512, overlap: int = 50, tokenizer: str | None = None) -> DataFrame:
    """Ordered pieces of at most ``limit`` tokens, with ``overlap`` tokens of the piece before at their start.

    ``tokenizer`` is the path of a public tokenizer's file; without it a text's
    tokens are its characters divided by 4, rounded down. Columns: ``SCHEMA``.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(section_col) if section_col else F.lit(None)).cast("string").alias("section")).where(F.col("text").isNotNull())
    rows = once(rows, "id", "text", "section")
    # a token is never less than a character, so shorter texts need no measuring
    small = F.length("text") < (4 * limit + 4 if tokenizer is None else limit + 1)

    def cut(batches):
        measure = BpeMeasure(tokenizer) if tokenizer else CharMeasure()
        for batch in batches:
            out: list[tuple] = []
            for i, t, s in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "section"))):
                pieces = split_text(t, limit, overlap, measure)
                out += [(i, k, len(pieces), s, t[a:b], measure.count(t, a, b), a, b, kind) for k, (a, b, kind) in enumerate(pieces)]
            cols = list(zip(*out)) or [()] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names=["id", "piece", "n_pieces", "section", "text", "n_tokens", "start_char", "end_char", "boundary"])

    large = rows.where(~small).mapInArrow(cut, SCHEMA)
    if tokenizer is not None:
        return large.unionByName(rows.where(small).mapInArrow(cut, SCHEMA))
    whole = rows.where(small).select("id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "section", "text", F.floor(F.length("text") / 4).cast("int").alias("n_tokens"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.lit("end").alias("boundary"))
    return whole.unionByName(large)
