"""Near-duplicate records by vertical partitioning of the global n-gram order.

1. *Order.* Every n-gram of every record is counted in a sketch of fixed size
   (2**sketch_bits counters), which the executors get as one byte per counter.
   (count class, hash) is the global order, rarest first. Any total order gives
   the same result; the counts only make it fast.
2. *Fragments.* The order is cut into fragments of about equal work. A record
   sends to each fragment only the part of its prefix (the n - ceil(t n) + 1
   rarest n-grams) that lies there, with its size and a parity bitmap.
   A fragment larger than ``fragment_postings`` is split into blocks of records
   and joined block pair by block pair, so no task holds an unbounded group.
3. *Candidates.* In a fragment, pairs that share an n-gram are kept if size,
   position and bitmap bounds (all of them upper bounds of the overlap) still
   allow the threshold. No link is lost.
4. *Partial overlaps.* For the surviving pairs each fragment's overlap is
   counted by itself, and the counts are summed per pair; the sum is exact.

Records of equal content (same words) form classes first; only one record per
class takes part, so copies cost no pairs.

Nulls and texts with fewer words than one n-gram have no n-grams: they are in
no pair and stand alone in the groups. Rows repeated with the same id count
once. An empty table gives an empty result. The input's other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import grams
from docmill.llm.common import hinted
from docmill.llm.components import connected_components
from docmill.storage import materialize

_U = np.uint64
_EPS = 1e-9
#: Classes of the count per doubling of the count.
_STEP = 6
#: Fragments that partial overlaps are counted in.
_PARTS = 4


def _hash_fn(kind: str, k: int):
    """texts -> (n-gram hashes, their text, two hashes of each text's word sequence)."""

    def make(texts: list[str]):
        h, doc, _, _ = grams.words(texts)
        keys = grams.sequence_keys(h, doc, len(texts))
        return *(grams.shingles_of_words(h, doc, k) if kind == "word" else grams.char_grams(texts, k)), *keys

    return make


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column("text").to_pylist()
    for a, b in grams.slices([len(t) for t in texts]):
        yield a, b, texts[a:b]


#: n-grams that a task counts together before it sends the counts on.
_FLUSH = 4_000_000


def first_pass(rows: DataFrame, kind: str, k: int, bits: int) -> DataFrame:
    """From (id, text): a row (id, hid, h2, has) per text with the hashes of its word sequence, and rows (bucket, n) with the number of n-grams by the top ``bits`` bits of their hash."""
    make = _hash_fn(kind, k)

    def flush(held):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        m = len(at)
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "hid", "h2", "has", "bucket", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a, b, part in _texts(batch):
                h, doc, k1, k2 = make(part)
                has = np.bincount(doc, minlength=b - a) > 0
                h, _ = grams.distinct_by_doc(h, doc)
                held.append((h >> _U(48 - bits)).astype(np.uint32))
                size += len(h)
                m = b - a
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, m), pa.array(k1), pa.array(k2), pa.array(has), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=["id", "hid", "h2", "has", "bucket", "n"])
                if size > _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "id string, hid bigint, h2 bigint, has boolean, bucket int, n int")


def gram_sketch(counts: DataFrame, bits: int) -> np.ndarray:
    """Classes of the logarithm of the counts, one byte for each of the 2**bits counters.

    The sums stay on the executors; the driver gets 2**bits bytes however large the input is.
    """
    low = max(0, bits - 12)

    def pack(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            b = at >> low
            q = np.minimum(255, 1 + np.floor(_STEP * np.log2(c))).astype(np.uint8)
            o = np.argsort(b, kind="stable")
            b, at, q = b[o], at[o], q[o]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
            for s, e in zip(cut, np.append(cut[1:], len(b)) if len(b) else []):
                blocks.setdefault(int(b[s]), np.zeros(1 << low, np.uint8))[at[s:e] & ((1 << low) - 1)] = q[s:e]
        for one, x in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["blk", "q"])

    sums = counts.where("bucket is not null").select("bucket", "n", F.shiftright("bucket", low).alias("blk")).repartition("blk").groupBy("blk", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((1 << min(12, bits), 1 << low), np.uint8)
    for r in sums.select("bucket", "n").mapInArrow(pack, "blk int, q binary").collect():
        out[r.blk] = np.frombuffer(r.q, np.uint8)
    return out.reshape(-1)


#: Pairs and postings of a fragment, about.
_PAIRS = 30_000_000


def _cuts(level: np.ndarray, t: float, per_fragment: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First fragment of each count class, the number of fragments that its hashes are cut into, and the blocks that each fragment is joined in.

    The share of a class that lies in prefixes is estimated from where it
    stands in the order: a record's part up to 1 - t is its prefix, the part
    up to 1 - 2t/(1+t) is what smaller partners are found by.
    """
    n = np.bincount(level, minlength=256).astype(float)
    df = np.exp2((np.arange(256) - 0.5) / _STEP)
    postings = n * df
    at = (np.cumsum(postings) - postings / 2) / max(1.0, postings.sum())
    inside = lambda x: 1 / (1 + np.exp(np.clip((at - x) / 0.08, -50, 50)))
    probe, index = inside(1 - t), inside(1 - 2 * t / (1 + t))
    postings[:2] = 0  # seen once at most: never shared
    postings *= probe
    pairs = postings * df * index / 2
    work = postings / per_fragment + pairs / _PAIRS
    want = max(least, math.ceil(work.sum()))
    unit = max(work.sum() / want, 1e-9)
    first, parts, frag, acc = np.zeros(256, np.int64), np.ones(256, np.int64), 0, 0.0
    for q in range(256):
        share = work[q] / unit
        if share > 1.5:
            frag += acc > 0
            first[q], parts[q] = frag, max(1, round(share))
            frag, acc = frag + parts[q], 0.0
        else:
            if acc and acc + share > 1.25:
                frag, acc = frag + 1, 0.0
            first[q] = frag
            acc += share
    # a single n-gram's postings cannot be cut by hashes: such fragments are joined block by block
    blocks = np.ones(int((first + parts).max()) + 1, np.int64)
    for q in range(2, 256):
        each = max(df[q] if n[q] else 0, postings[q] / parts[q])
        blocks[first[q] : first[q] + parts[q]] = np.maximum(blocks[first[q]], math.ceil(each * probe[q] / (2 * per_fragment)))
    return first, parts, blocks


def _bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmap of a record with n n-grams: a power of two from 256 on, at least 3 n."""
    return 256 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) * 3 / 256))).astype(np.int64)


def _prefixes(kind: str, k: int, t: float, bits: int, level_b, first: np.ndarray, parts: np.ndarray, blocks: np.ndarray):
    make = _hash_fn(kind, k)

    def run(batches):
        level = np.frombuffer(level_b.value, np.uint8)
        for batch in batches:
            for a, b, part in _texts(batch):
                h, doc, hids, _ = make(part)
                h, doc = grams.distinct_by_doc(h, doc)
                n = np.bincount(doc, minlength=b - a)
                q = level[(h >> _U(48 - bits)).astype(np.int64)]
                key = np.sort((doc.astype(np.uint64) << _U(48)) | (q.astype(np.uint64) << _U(40)) | (h & _U((1 << 40) - 1)))
                d = (key >> _U(48)).astype(np.int64)
                start = np.concatenate([[0], np.cumsum(n)])
                pos = np.arange(len(key)) - start[d]
                q = ((key >> _U(40)) & _U(255)).astype(np.int64)
                keep = (pos < (n - np.ceil(t * n - _EPS) + 1)[d]) & (q > 1)
                # bitmaps: each n-gram flips one bit
                m = _bitmap_bits(n)
                byte0 = np.concatenate([[0], np.cumsum(m // 8)])
                flip = np.bincount(byte0[doc] * 8 + (mix_low(h) & (m[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=byte0[-1] * 8) & 1
                sig = np.packbits(flip.astype(np.uint8), bitorder="little").tobytes()
                d, q, pos, tok = d[keep], q[keep], pos[keep], (key[keep] & _U((1 << 40) - 1))
                frag = first[q] + ((tok * parts[q].astype(np.uint64)) >> _U(40)).astype(np.int64)
                if not len(d):
                    continue
                o = np.lexsort((frag, d))
                d, frag, pos, tok = d[o], frag[o], np.minimum(pos[o], 65535).astype(np.uint16), (mix_low(tok[o] + (q[o].astype(np.uint64) << _U(40))) & _U(0xFFFFFFFF)).astype(np.uint32)
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (frag[1:] != frag[:-1])]))
                sigs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(byte0.astype(np.int32)), pa.py_buffer(sig)])
                off = np.append(cut, len(d)).astype(np.int32)
                toks, poss = (pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(off * x.itemsize), pa.py_buffer(x)]) for x in (tok, pos))
                # a fragment joined in blocks gets the record once for each block
                d, frag = d[cut], frag[cut]
                nb = blocks[frag]
                at, other = np.repeat(np.arange(len(cut)), nb), _spread(np.zeros(len(cut), np.int64), nb)
                hid, many = hids[d[at]], nb[at]
                mine = ((hid.astype(np.uint64) * _U(0x9E3779B1) & _U(0xFFFFFFFF)) * many.astype(np.uint64) >> _U(32)).astype(np.int64)
                if len(at) > len(cut):
                    toks, poss = toks.take(pa.array(at)), poss.take(pa.array(at))
                ints = [pa.array(x.astype(np.int32)) for x in (frag[at], np.minimum(mine, other), np.maximum(mine, other), mine > other)]
                yield pa.RecordBatch.from_arrays([*ints, pa.array(hid), pa.array(n[d[at]].astype(np.int32)), sigs.take(pa.array(d[at])), toks, poss], names=["frag", "i", "j", "side", "hid", "n", "sig", "tok", "pos"])

    return run


def mix_low(h: np.ndarray) -> np.ndarray:
    return grams.mix(h * _U(0xA24BAED4963EE407) + _U(1))


def _ragged(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if len(col) and off[-1] > off[0] else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return data.view(dtype) if data.size and data.ctypes.data % size == 0 else np.frombuffer(data.tobytes(), dtype), np.diff(off) // size


def _spread(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, …, count[0] of them, then those of lo[1] and so on."""
    ends = np.cumsum(count)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(lo - (ends - count), count)


def fragment_pairs(hid, n, sig, sig_words, tok, tok_n, pos, block, t: float, batch: int = 400_000, most_postings: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one fragment: (hid of the smaller record, hid of the larger), a pair perhaps several times.

    ``block`` is 0 or 1 for each record when two blocks are joined with each
    other (then only pairs across count), or None. Besides 10 bytes a posting
    and the records' bitmaps, memory holds ``most_postings`` postings and
    ``batch`` pairs at a time (or the postings of one n-gram, if they are more).
    """
    order = np.lexsort((hid, n))  # by size: a partner that is not larger comes before
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    sig_start = np.concatenate([[0], np.cumsum(sig_words)])[:-1]
    key = tok.astype(np.uint64) << _U(32)
    key |= np.repeat(rank, tok_n)
    o = np.argsort(key)
    key = key[o]
    pos = pos[o]
    del o
    tok, d = (key >> _U(32)).astype(np.uint32), (key & _U(0xFFFFFFFF)).astype(np.int32)
    del key
    same = tok[1:] == tok[:-1]
    keep = np.append(same, False) | np.concatenate([[False], same])[: len(tok)]  # n-grams of one record alone pair nothing
    tok, d, pos = tok[keep], d[keep], pos[keep]
    del same, keep
    hid, n, sig_start, sig_words = hid[order], n[order].astype(np.int32), sig_start[order], sig_words[order]
    block = None if block is None else block[order]
    if not len(tok):
        return
    ratio = t / (1 + t)
    both = np.arange(2 * int(n.max()) + 1)
    most = np.floor(both - 2 * np.ceil(ratio * both - _EPS) + _EPS).astype(np.int32)  # differing n-grams, by the sum of the sizes
    tables = _folded(sig, sig_start, sig_words)
    del sig, sig_start
    starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    a = 0
    while a < len(tok):
        i = int(np.searchsorted(starts, a + most_postings, side="right"))
        if len(tok) - a <= most_postings:
            b = len(tok)
        elif starts[i - 1] > a:  # whole n-grams
            b = int(starts[i - 1])
        else:
            b = int(starts[i]) if i < len(starts) else len(tok)
        for x, y in _range_pairs(tok[a:b], d[a:b], pos[a:b], n, ratio, t, batch, most_postings):
            if block is not None:
                ok = block[x] != block[y]
                x, y = x[ok], y[ok]
            # the smallest bitmaps first: one row each decides most pairs
            ok = np.flatnonzero(_differing(tables[0][1], x, y) <= most[n[x] + n[y]])
            if not len(ok):
                continue
            pair = grams.distinct(x[ok].astype(np.int64) * len(n) + y[ok])
            x, y = pair // len(n), pair % len(n)
            wide = np.minimum(sig_words[x], sig_words[y])
            for w, table, row in tables[1:]:  # then wider ones, of the pairs that have them
                m = np.flatnonzero(wide >= w)
                bad = m[_differing(table, row[x[m]], row[y[m]]) > most[n[x[m]] + n[y[m]]]]
                if len(bad):
                    keep = np.ones(len(x), bool)
                    keep[bad] = False
                    x, y, wide = x[keep], y[keep], wide[keep]
            yield hid[x], hid[y]
        a = b


def _range_pairs(tok, d, pos, n, ratio: float, t: float, batch: int, most_postings: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ranks that share one of some whole n-grams and that their sizes and positions allow."""
    size = n[d]
    # may a record be the smaller one of a pair with this as the first shared n-gram?
    reach = np.floor((size - pos.astype(np.int32)) / ratio + _EPS).astype(np.int32) - size  # largest partner
    index = np.flatnonzero(reach >= size)
    if not len(index):
        return
    span = np.int64(n.max() + 2)
    gram = np.cumsum(np.concatenate([[False], tok[1:] != tok[:-1]])).astype(np.int64)
    ikey = gram[index] * span + size[index]
    idoc, ireach = d[index], reach[index]
    for s in range(0, len(tok), most_postings):
        part = slice(s, s + most_postings)
        g, z = gram[part] * span, size[part]
        lo = np.searchsorted(ikey, g + np.ceil(t * z - _EPS).astype(np.int64), side="left")
        hi = np.searchsorted(ikey, g + np.minimum(z, np.maximum(reach[part], 0)), side="right")
        # among records of the same size, only those of smaller rank
        hi = np.minimum(hi, np.searchsorted(index, np.arange(s, s + len(z)), side="left"))
        count = np.maximum(0, hi - lo)
        probe = np.flatnonzero(count)
        ends = np.cumsum(count[probe])
        at = 0
        while at < len(probe):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + batch, side="right")))
            p = probe[at:to]
            at = to
            for q, c, low in _pieces(p, count, lo, batch):
                x_at = _spread(low, c)
                ok = np.flatnonzero(ireach[x_at] >= np.repeat(z[q], c))
                yield idoc[x_at[ok]], np.repeat(d[part][q], c)[ok]


def _folded(sig: np.ndarray, start: np.ndarray, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, bitmaps, row of each record) for each bitmap size in use, smallest first: the bitmaps of all records of at least that size, folded to it."""
    out = []
    for w in np.unique(words):
        has = words >= w
        row = (np.cumsum(has) - 1).astype(np.int32)
        table = np.zeros((int(has.sum()), w), np.uint64)
        for v in np.unique(words[has]):
            every = np.flatnonzero(words == v)
            for at in range(0, len(every), 65536):
                of = every[at : at + 65536]
                full = sig[start[of][:, None] + np.arange(v)]
                table[row[of]] = np.bitwise_xor.reduce(full.reshape(len(of), v // w, w), axis=1)
        out.append((int(w), table, row))
    return out


def _differing(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of 4 words or a multiple differ (256 bits of difference in 4 words count as none: a bound that keeps more)."""
    ham = np.zeros(len(x), np.int32)
    step = max(1, 1_600_000 // table.shape[1])
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        bits = np.bitwise_count(table[x[part]] ^ table[y[part]]).view(np.uint32)
        for i in range(bits.shape[1]):
            ham[part] += (bits[:, i] * np.uint32(0x01010101) >> np.uint32(24)).astype(np.int32)
    return ham


def _pieces(p: np.ndarray, count: np.ndarray, lo: np.ndarray, batch: int):
    """The probes' ranges as they are, or one probe's long range cut up."""
    if len(p) > 1 or count[p[0]] <= batch:
        yield p, count[p], lo[p]
        return
    for s in range(0, int(count[p[0]]), batch):
        yield p, np.array([min(batch, count[p[0]] - s)]), lo[p] + s


#: Pairs that a fragment holds before they are sent on.
_HELD = 500_000


def _join_fragment(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list[np.ndarray]] = {c: [] for c in ("hid", "n", "side", "sig", "sig_words", "tok", "tok_n", "pos")}
        across = False
        for x in batches:  # copied, so that a batch is freed before the next one comes
            across |= bool(x.num_rows) and x.column("i")[0] != x.column("j")[0]
            for c in ("hid", "n", "side"):
                cols[c].append(x.column(c).to_numpy(zero_copy_only=False).copy())
            for c, size, ty in (("sig", "sig_words", np.uint64), ("tok", "tok_n", np.uint32), ("pos", None, np.uint16)):
                values, many = _ragged(x.column(c), ty)
                cols[c].append(values.copy())
                if size:
                    cols[size].append(many)
        one = {}
        for c in list(cols):
            one[c] = np.concatenate(cols.pop(c))
        side = one.pop("side")
        held, size = [], 0
        for a, b in fragment_pairs(one.pop("hid"), one.pop("n"), one.pop("sig"), one.pop("sig_words"), one.pop("tok"), one.pop("tok_n"), one.pop("pos"), side if across else None, t):
            held.append((np.minimum(a, b), np.maximum(a, b)))
            size += len(a)
            if size > _HELD:
                yield _pair_batch(held)
                held, size = [], 0
        yield _pair_batch(held)

    return run


def _pair_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Different pairs of what is held."""
    a, b = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in range(2))
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return pa.RecordBatch.from_arrays([pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64())], names=["ha", "hb"])


def _gram_arrays(kind: str, k: int):
    """Full n-gram sets, cut into fragments of the hash order."""
    make = _hash_fn(kind, k)

    def run(batches):
        for batch in batches:
            for a, b, part in _texts(batch):
                h, doc, k1, k2 = make(part)
                o = np.lexsort((h, doc))
                h, doc = h[o], doc[o]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
                h, doc = h[new], doc[new]
                n = np.bincount(doc, minlength=b - a)
                frag = (h >> _U(64 - int(math.log2(_PARTS)))).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (frag[1:] != frag[:-1])])) if len(h) else np.zeros(0, np.int64)
                if not len(cut):
                    continue
                d = doc[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[d]), pa.array(k2[d]), pa.array(n[d].astype(np.int32)), pa.array(frag[cut].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(cut, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["hid", "h2", "n", "frag", "toks"],
                )

    return run


class NearDuplicates:
    """The operator over one table: ``members`` (id, hid, h2, has) and ``links`` between classes of equal content."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, kind: str = "word", sketch_bits: int = 24, fragment_postings: int = 2_000_000):
        t = float(threshold)
        if not 0 < t <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        spark = df.sparkSession
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        once_more = materialize(first_pass(rows, kind, k, sketch_bits), "first")
        self.members = once_more.where("id is not null").select("id", "hid", "h2", "has").distinct()
        level = gram_sketch(once_more, sketch_bits)
        first, parts, blocks = _cuts(level, t, fragment_postings, 8)
        shared = spark.sparkContext.broadcast(level.tobytes())  # 2**sketch_bits bytes, whatever the input
        # of the rows of one class, one takes part; only repeated classes and ids are shuffled with their texts
        every = once_more.where("id is not null").select("id", "hid", "h2")
        many = every.groupBy("hid", "h2").agg(F.count("*").alias("c")).where("c > 1").select("hid", "h2")
        again = every.join(many, ["hid", "h2"], "left_semi").distinct()
        again = hinted(materialize(again, "again"))
        one_of = rows.join(again, "id", "left_anti").select("text").unionByName(rows.join(again, "id").dropDuplicates(["hid", "h2"]).select("text"))
        prefix = one_of.mapInArrow(_prefixes(kind, k, t, sketch_bits, shared, first, parts, blocks), "frag int, i int, j int, side int, hid bigint, n int, sig binary, tok binary, pos binary")
        cand = materialize(prefix.groupBy("frag", "i", "j").applyInArrow(_join_fragment(t), "ha bigint, hb bigint").distinct(), "candidates")
        seen = cand.select(F.col("ha").alias("hid")).union(cand.select(F.col("hb").alias("hid"))).distinct()
        ids = every.join(seen, "hid", "left_semi").groupBy("hid", "h2").agg(F.min("id").alias("id")).select("id").distinct()
        ids = hinted(materialize(ids, "ids"))
        arrays = materialize(rows.join(ids, "id", "left_semi").mapInArrow(_gram_arrays(kind, k), "hid bigint, h2 bigint, n int, frag int, toks array<bigint>").dropDuplicates(["hid", "h2", "frag"]), "grams")
        side = lambda x: arrays.select(F.col("hid").alias(f"h{x}"), F.col("h2").alias(f"g{x}"), F.col("n").alias(f"n{x}"), "frag", F.col("toks").alias(f"t{x}"))
        partial = cand.join(side("a"), "ha").join(side("b"), ["hb", "frag"]).select("ha", "ga", "hb", "gb", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
        total = partial.groupBy("ha", "ga", "hb", "gb", "na", "nb").agg(F.sum("o").alias("o"))
        sim = F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
        self.links = materialize(total.select("ha", "ga", "hb", "gb", sim.alias("similarity")).where(F.col("similarity") >= t - 1e-12), "links")

    def pairs(self) -> DataFrame:
        """(id_a < id_b, similarity) of all pairs of members of linked classes and of members of one class. The size is that of the result."""
        m = self.members.where("has").select("id", "hid", "h2")
        many = m.groupBy("hid", "h2").agg(F.count("*").alias("c")).where("c > 1").select("hid", "h2")
        copies = m.join(many, ["hid", "h2"], "left_semi")
        inside = copies.withColumnRenamed("id", "a").join(copies.withColumnRenamed("id", "b"), ["hid", "h2"]).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
        a = m.select(F.col("hid").alias("ha"), F.col("h2").alias("ga"), F.col("id").alias("a"))
        b = m.select(F.col("hid").alias("hb"), F.col("h2").alias("gb"), F.col("id").alias("b"))
        across = self.links.join(a, ["ha", "ga"]).join(b, ["hb", "gb"]).where("a <> b").select("a", "b", "similarity")
        return inside.unionByName(across).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """One row per id: (id, class_id, group_id, n_copies, n_links)."""
        key = F.concat_ws("-", F.hex("hid"), F.hex("h2"))
        members = self.members.select("id", key.alias("cls")).distinct()
        classes = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
        links = self.links.select(F.concat_ws("-", F.hex("ha"), F.hex("ga")).alias("cls_a"), F.concat_ws("-", F.hex("hb"), F.hex("gb")).alias("cls_b"))
        ends = links.select(F.col("cls_a").alias("cls")).unionAll(links.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
        named = links.join(classes.select(F.col("cls").alias("cls_a"), F.col("class_id").alias("a")), "cls_a").join(classes.select(F.col("cls").alias("cls_b"), F.col("class_id").alias("b")), "cls_b").select("a", "b")
        group = connected_components(named, "a", "b").withColumnRenamed("node", "class_id").withColumnRenamed("component", "group_id")
        out = members.join(classes.join(ends, "cls", "left").join(group, "class_id", "left"), "cls")
        return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, kind: str = "word", **kw) -> DataFrame:
    """All pairs (id_a < id_b, similarity) of different ids, copies included, whose n-gram sets have a Jaccard similarity of at least ``threshold``."""
    return NearDuplicates(df, id_col, text_col, threshold, k, kind, **kw).pairs()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, kind: str = "word", **kw) -> DataFrame:
    """One row per id: (id, class_id, group_id, n_copies, n_links).

    ``class_id`` is the smallest id with the same content, ``group_id`` the
    smallest id that a chain of links leads to, ``n_copies`` the ids of the
    class and ``n_links`` the number of other classes that it is linked to.
    """
    return NearDuplicates(df, id_col, text_col, threshold, k, kind, **kw).groups()
