"""Evaluation texts inside a corpus, by template canonicalisation.

Every word becomes itself if the evaluation items use it as an ordinary word
(somewhere in small letters), a unit after a number, a number placeholder, or
the name placeholder. Windows of ``window`` such tokens are hashed and the
corpus windows are hash-joined with the items' windows. A joined window is

* *exact* if all words are the same, letter case ignored;
* *reparameterised* if the slots agree: equal values of the item stand for
  equal values of the document and different ones for different ones, and at
  least ``literal`` tokens are ordinary words.

A window with fewer ordinary words is joined by the hash of its words, so that
windows made of placeholders alone meet no strangers. An item shorter than the
window is one window by itself; where a document holds it, the kind is *short*.

What the executors get is of fixed size whatever the items: a bitmap of the
ordinary words and one of the items' windows. One scan of the documents keeps
the windows whose bit is set; only those are shuffled, once for each document,
and joined. A word or window whose bit is set by chance is treated alike on
both sides, and the join compares whole hashes and words.

Words are maximal runs of letters and digits. Null texts, and texts without a
window, are in no result. Repeated rows count once. Whole texts are used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import grams
from docmill.storage import materialize

_U = np.uint64
NUMBER, NAME, UNIT = _U(11), _U(13), _U(17)
#: Bits of the hashes that the two bitmaps are addressed by.
WORD_BITS, WINDOW_BITS = 22, 27
# Units of measure.
UNITS = frozenset("mm cm m km g kg t mg l ml s sec min h hr hrs hour hours day days week weeks month months year years percent pct eur usd gbp mb gb tb kb w kw v a hz ºc °c c f".split())
_SCHEMA = "id string, key bigint, words array<bigint>, plain int, at bigint"


def _has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = (h >> _U(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of a column ``h`` of hashes; it is put together in blocks on the executors, and the driver gets 2**bits bits at most."""
    block = 15

    def pack(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> _U(64 - bits)).astype(np.int64)
            for b in np.unique(at >> block).tolist():
                x = blocks.setdefault(b, np.zeros(1 << (block - 3), np.uint8))
                one = at[at >> block == b] & ((1 << block) - 1)
                np.bitwise_or.at(x, one >> 3, (1 << (one & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["b", "x"])

    near = hashes.select("h").distinct().repartition(F.shiftrightunsigned("h", 64 - bits + block))
    out = np.zeros((1 << (bits - block), 1 << (block - 3)), np.uint8)
    for r in near.mapInArrow(pack, "b int, x binary").toLocalIterator():
        out[r.b] |= np.frombuffer(r.x, np.uint8)
    return out.reshape(-1)


def _hash_words(ws) -> np.ndarray:
    ws = sorted(ws)
    return np.sort(grams.words(ws)[0]) if ws else np.zeros(0, np.uint64)


def _slots(h: np.ndarray, doc: np.ndarray, cp: np.ndarray, s: np.ndarray, e: np.ndarray, ordinary: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Template token of each word, and whether it is an ordinary one."""
    digits = np.concatenate([[0], np.cumsum((cp >= 48) & (cp <= 57))])
    number = digits[e] > digits[s]
    after = np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])]) if len(h) else number
    at = np.minimum(np.searchsorted(units, h), len(units) - 1)
    unit = (units[at] == h) & after
    plain = _has(ordinary, h, WORD_BITS) & ~number & ~unit
    return np.where(unit, UNIT, np.where(number, NUMBER, np.where(plain, h, NAME))), plain


def _windows(texts: list[str], ordinary: np.ndarray, units: np.ndarray, k: int, literal: int):
    """(word hashes, their text, join key, ordinary words, first word) of every window of k words."""
    low = [t.lower() for t in texts]
    h, doc, s, e = grams.words(low)
    m = len(h) - k + 1
    if m <= 0:
        return h, doc, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp, _ = grams.code_points([t.lower() for t in low])
    t, plain = _slots(h, doc, cp, s, e, ordinary, units)
    mixed, same = grams.mix(t), grams.mix(h + _U(5))
    template, words = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for i in range(k):
        template = template * _U(0xD6E8FEB86659FD93) + mixed[i : i + m]
        words = words * _U(0xD6E8FEB86659FD93) + same[i : i + m]
    count = np.concatenate([[0], np.cumsum(plain)])
    count = count[k:] - count[:-k]
    first = np.flatnonzero(doc[:m] == doc[k - 1 :])
    key = np.where(count >= literal, grams.mix(template), grams.mix(words + _U(3)))
    return h, doc, key[first], count[first], first


def _rows(batch: pa.RecordBatch, a: int, b: int, doc, h, key, count, first, k: int) -> pa.RecordBatch:
    words = h[first[:, None] + np.arange(k)] if len(first) else np.zeros((0, k), np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * k), pa.array(words.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a).take(pa.array(doc[first])), pa.array(key.view(np.int64)), lists, pa.array(count.astype(np.int32)), pa.array(first)], names=["id", "key", "words", "plain", "at"])


def _emit(word_map, window_map, units: np.ndarray, k: int, literal: int):
    """(id, text) -> windows of k words; only those in the bitmap where there is one."""

    def run(batches):
        ordinary = np.frombuffer(word_map.value, np.uint8)
        wanted = None if window_map is None else np.frombuffer(window_map.value, np.uint8)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in grams.slices([len(t) for t in texts]):
                h, doc, key, count, first = _windows(texts[a:b], ordinary, units, k, literal)
                if wanted is not None and len(key):
                    keep = _has(wanted, key, WINDOW_BITS)
                    key, count, first = key[keep], count[keep], first[keep]
                if len(key):
                    yield _rows(batch, a, b, doc, h, key, count, first, k)

    return run


def _lengths(batches):
    """(id, words in small letters only as hashes, number of words) of each item."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        small = [np.unique(_hash_words({w for w in re.findall(r"[^\W_]+", t) if w.islower()} - UNITS)).view(np.int64).tolist() for t in texts]
        n = [len(re.findall(r"[^\W_]+", t.lower())) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(small, pa.list_(pa.int64())), pa.array(n, pa.int32())], names=["id", "text", "small", "n"])


def _distinct_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = 13, literal: int = 5) -> DataFrame:
    """(doc_id, item_id, kind, n_windows): the strongest kind of "exact", "reparameterised" and "short", and the item's different windows that were found."""
    sc = docs.sparkSession.sparkContext
    read = materialize(_distinct_rows(items, item_id, item_text).distinct().mapInArrow(_lengths, "id string, text string, small array<bigint>, n int"), "items")
    words = sc.broadcast(_bitmap(read.select(F.explode("small").alias("h")), WORD_BITS).tobytes())  # fixed size
    units = _hash_words({u for u in UNITS if u.isalnum()})
    base = _distinct_rows(docs, id_col, text_col)
    # the window's length, and those of the shorter items: at most ``window`` of them
    lengths = sorted(r.k for r in read.where("n > 0").select(F.least("n", F.lit(window)).alias("k")).distinct().collect())
    out = None
    for k in lengths:
        few = literal if k == window else k + 1  # a short item is found by its words alone
        part = read.where(F.col("n") >= window if k == window else F.col("n") == k).select("id", "text")
        asked = materialize(part.mapInArrow(_emit(words, None, units, k, few), _SCHEMA).groupBy("id", "key", "words").agg(F.min("plain").alias("plain")), "asked")
        wanted = sc.broadcast(_bitmap(asked.select(F.col("key").alias("h")), WINDOW_BITS).tobytes())  # fixed size
        held = base.mapInArrow(_emit(words, wanted, units, k, few), _SCHEMA).select(F.col("id").alias("doc_id"), "key", F.col("words").alias("there")).distinct()
        j = held.join(asked.withColumnRenamed("id", "item_id"), "key")
        same = F.col("words") == F.col("there")
        pairs = F.size(F.array_distinct(F.arrays_zip("words", "there")))
        slots = (F.col("plain") >= few) & (pairs == F.size(F.array_distinct("words"))) & (pairs == F.size(F.array_distinct("there")))
        kind = F.when(same, 2 if k == window else 0).when(slots, 1)
        one = j.select("doc_id", "item_id", "key", kind.alias("kind")).where("kind is not null").groupBy("doc_id", "item_id", "key").agg(F.max("kind").alias("kind"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return base.select(F.col("id").alias("doc_id"), F.lit("").alias("item_id"), F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("n_windows")).where(F.lit(False))
    best = out.groupBy("doc_id", "item_id").agg(F.max("kind").alias("k"), F.count("*").alias("n_windows"))
    return best.select("doc_id", "item_id", F.element_at(F.array(*[F.lit(x) for x in ("short", "reparameterised", "exact")]), F.col("k") + 1).alias("kind"), "n_windows")
