"""Personal data in free text: a linear-chain conditional random field.

Tokens are runs of non-blank characters with outer punctuation split off.
Features are the word (digits as 0), its shape, prefix, suffix and a few
character facts of the tokens from two before to two after; labels are B-/I-
of person, email, phone, id_number and address, and O. Training maximises the
penalised likelihood of ``pii_examples.labelled_rows`` by full-batch gradient
steps; the model is the same on every run.

Decoding runs over numpy batches. A token's emission is a sum of rows that
depend on one word each, so words are scored once per task. A token whose O
leads every other label by more than all transitions together can win is O in
the best path; Viterbi then runs exactly over the short stretches between. An
exact check of each kind's form follows, which also completes names. It knows
from counts over the whole corpus which words are mostly small or very frequent
and so no parts of names.

Null texts stay null and have no spans, blank texts stay as they are. Every
row is treated alone. Whole texts are used whatever their length.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import grams
from docmill.llm.pii_examples import COMPANY, GIVEN, KINDS, SHORT, SHORTENED, SURNAMES, clean_sentences, labelled_rows
from docmill.storage import materialize

_U = np.uint64
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
NL = len(LABELS)
OFFSETS = (-2, -1, 0, 1, 2)
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
# Punctuation that does not belong to a token at its ends.
LEAD = "([{<\"'“„«‘|/#*>-–—•_"
TRAIL = ".,;:!?)]}>\"'”»’|/…"


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, text starts, token starts, token ends), offsets from the joined start."""
    cp, starts = grams.code_points(texts)
    blank = _table("blank", str.isspace)[np.minimum(cp, 0xFFFF)] | (cp == 10)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(cp) and not blank[0]:
        edge = np.concatenate([[0], edge])
    s, e = edge[0::2].copy(), edge[1::2].copy()
    lead, trail = _table("lead", LEAD.__contains__), _table("trail", TRAIL.__contains__)
    ps = []
    for _ in range(3):
        m = (e - s > 1) & lead[np.minimum(cp[s], 0xFFFF)]
        ps.append(s[m])
        s = s + m
    for _ in range(3):
        m = (e - s > 1) & trail[np.minimum(cp[e - 1], 0xFFFF)]
        e = e - m
        ps.append(e[m])
    p = np.concatenate(ps) if ps else np.zeros(0, np.int64)
    s, e = np.concatenate([s, p]), np.concatenate([e, p + 1])
    o = np.argsort(s, kind="stable")
    return cp, starts, s[o], e[o]


def _table(name: str, f) -> np.ndarray:
    st = grams._state
    if name not in st:
        st[name] = np.array([f(chr(i)) for i in range(0x10000)])
    return st[name]


def _hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens with digits as 0, and those code points."""
    c = np.where((cp >= 48) & (cp <= 57), 48, cp).astype(np.uint64)
    up, down = grams._powers(len(c))
    p = np.concatenate([[_U(0)], np.cumsum(grams.mix(c + _U(0x3779)) * up[: len(c)], dtype=np.uint64)])
    return grams.mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64)), c


_FULL_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")


def features(w: str) -> list[str]:
    """Facts of one token; digits are 0 already."""
    low = w.lower()
    shape = "".join("0" if c == "0" else "X" if c.isupper() else "x" if c.islower() else c for c in w)
    short = "".join(c for i, c in enumerate(shape) if not i or shape[i - 1] != c)
    out = ["", "w=" + low[:24], "s=" + shape[:16], "t=" + short[:10], "q=" + low[-3:], "r=" + low[-2:], "n=" + str(min(len(w), 9)), "v=" + ("v" if low[-1] in "aeiouyáéí" else "c")]
    if "@" in w:
        out.append("@" + str(bool(_FULL_MAIL.fullmatch(low))))
    if low in _GIVEN or low.rstrip(".") in _TITLE or low.replace(".", "") in _FIRM:
        out.append("known=" + ("given" if low in _GIVEN else "title" if low.rstrip(".") in _TITLE else "firm"))
    if "0" in w:
        out.append("0=" + str(min(w.count("0"), 12)))
        out.append("z=" + "".join(sorted({c for c in w if not c.isalnum()})))
    if w[0].isupper():
        out.append("C" + ("U" if w.isupper() and len(w) > 1 else ""))
    if "." in w:
        out.append("." + low.rsplit(".", 1)[-1][:6])
    return out


#: Nats that label O pays for each token: a miss costs more than a false alarm, which the exact check of the forms can still stop.
O_COST = 13.0


class Crf:
    """Weights per feature and offset, transitions, and the exact pruning bound."""

    def __init__(self, index: dict[str, int], theta: np.ndarray, trans: np.ndarray, plain: frozenset[str] = frozenset()):
        self.index, self.theta, self.trans, self.plain = index, theta, trans, plain
        t = trans
        # by how much a token's other label can win over O through the two transitions at it
        gain = np.max([np.max(t[:, y][:, None] + t[y, :][None, :] - t[:, 0][:, None] - t[0, :][None, :]) for y in range(1, NL)])
        self.bound = float(gain) + 1e-6
        self._fresh()

    def _fresh(self):
        self.known, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(OFFSETS) * NL), np.float32)

    def __getstate__(self):
        return {"index": self.index, "theta": self.theta, "trans": self.trans, "bound": self.bound, "plain": self.plain}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self._fresh()

    def word_row(self, w: str) -> np.ndarray:
        at = [self.index[f] for f in features(w) if f in self.index]
        return self.theta[at].sum(0)

    def _known_rows(self, h: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Row number of each token in ``self.rows``."""
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, u)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            if len(self.known) > 300_000:
                self._fresh()
                return self._known_rows(h, c, s, e)
            f = first[new]
            texts = [c[a:b].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(s[f].tolist(), e[f].tolist())]
            rows = np.stack([self.word_row(w) for w in texts]).astype(np.float32)
            known = np.concatenate([self.known, u[new]])
            o = np.argsort(known, kind="stable")
            self.known, self.rows = known[o], np.concatenate([self.rows, rows])[o]
        return np.searchsorted(self.known, u)[inv]

    def emissions(self, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(tokens x labels); neighbours outside the text count as nothing."""
        n = len(row)
        out = np.zeros((n, NL), np.float32)
        out[:, 0] = -O_COST
        for i, o in enumerate(OFFSETS):
            part = self.rows[:, i * NL : (i + 1) * NL]
            a, b = max(0, -o), min(n, n - o)
            if b <= a:
                continue
            x = part[row[a + o : b + o]]
            x[doc[a:b] != doc[a + o : b + o]] = 0
            out[a:b] += x
        return out

    def decode(self, doc: np.ndarray, em: np.ndarray) -> np.ndarray:
        """Labels of the best path of each text."""
        n = len(em)
        label = np.zeros(n, np.int8)
        free = np.flatnonzero(em[:, 0] - em[:, 1:].max(1) <= self.bound)
        if not len(free):
            return label
        cut = np.flatnonzero(np.concatenate([[True], (free[1:] != free[:-1] + 1) | (doc[free[1:]] != doc[free[:-1]])]))
        size = np.diff(np.append(cut, len(free)))
        begin = free[cut]
        o = np.argsort(-size, kind="stable")
        begin, size = begin[o], size[o]
        # before a stretch comes O (a text's start counts as O), after it O
        score = self.trans[0][None, :] + em[begin]
        active, back = len(begin), []
        final = np.zeros(len(begin), np.int64)
        for t in range(1, int(size[0]) + 1):
            left = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
            done = slice(left, active)
            final[done] = np.argmax(score[done] + self.trans[:, 0][None, :], 1)
            if not left:
                break
            step = score[:left, :, None] + self.trans[None]
            back.append(step.argmax(1).astype(np.int8))
            score = step.max(1) + em[begin[:left] + t]
            active = left
        cur = final
        for t in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, side="left"))
            label[begin[:m] + t] = cur[:m]
            if t:
                cur = cur.copy()
                cur[:m] = back[t - 1][np.arange(m), cur[:m]]
        return label

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text index, start, end, kind number) of the personal data found."""
        cp, starts, s, e = tokenize(texts)
        if not len(s):
            return (np.zeros(0, np.int64),) * 4
        doc = np.searchsorted(starts, s, side="right") - 1
        h, c = _hashes(cp, s, e)
        label = self.decode(doc, self.emissions(doc, self._known_rows(h, c, s, e)))
        hit = np.flatnonzero(label)
        if not len(hit):
            return (np.zeros(0, np.int64),) * 4
        kind = (label[hit] - 1) // 2
        begin = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (kind[1:] != kind[:-1]) | ((label[hit][1:] - 1) % 2 == 0) | (doc[hit[1:]] != doc[hit[:-1]])])
        first = np.flatnonzero(begin)
        last = np.append(first[1:], len(hit)) - 1
        d = doc[hit[first]]
        return d, s[hit[first]] - starts[d], e[hit[last]] - starts[d], kind[first].astype(np.int64)


def _encode(rows: list[tuple[str, list[tuple[int, int, str]]]]):
    texts = [t for t, _ in rows]
    cp, starts, s, e = tokenize(texts)
    doc = np.searchsorted(starts, s, side="right") - 1
    gold = np.zeros(len(s), np.int64)
    for d, (_, spans) in enumerate(rows):
        for a, b, kind in spans:
            m = np.arange(np.searchsorted(s, starts[d] + a), np.searchsorted(s, starts[d] + b))
            if len(m):
                k = 1 + 2 * KINDS.index(kind)
                gold[m] = k + 1
                gold[m[0]] = k
    return cp, s, e, doc, gold


#: Tokens of the labelled table that a feature must be seen on: rarer ones would only learn invented words by heart.
LEAST_SEEN = 6


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 75, penalty: float = 0.04, rate: float = 0.3) -> Crf:
    """Maximum penalised likelihood by full-batch steps with per-weight rates (Adam)."""
    rows = sorted(rows, key=lambda r: -len(r[0].split()))
    cp, s, e, doc, gold = _encode(rows)
    h, c = _hashes(cp, s, e)
    u, first, word = np.unique(h, return_index=True, return_inverse=True)
    facts = [features(c[s[i] : e[i]].astype(np.uint32).tobytes().decode("utf-32-le")) for i in first]
    seen: dict[str, int] = {}
    for fs, times in zip(facts, np.bincount(word).tolist()):
        for f in fs:
            seen[f] = seen.get(f, 0) + times
    index: dict[str, int] = {}
    wf = [[index.setdefault(f, len(index)) for f in fs if seen[f] >= LEAST_SEEN] for fs in facts]
    fw = np.repeat(np.arange(len(u)), [len(x) for x in wf])
    ff = np.concatenate([np.array(x) for x in wf])
    order = np.argsort(ff, kind="stable")
    fw_s, ff_s = fw[order], ff[order]
    f_start = np.searchsorted(ff_s, np.arange(len(index)))
    w_start = np.concatenate([[0], np.cumsum([len(x) for x in wf])])[:-1]
    theta, trans = np.zeros((len(index), len(OFFSETS) * NL), np.float32), np.zeros((NL, NL), np.float32)
    n_doc, n, n_words = int(doc.max()) + 1, len(doc), len(u)
    length = np.bincount(doc, minlength=n_doc)
    rank = np.empty(n_doc, np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(n_doc)  # longest first, so that the texts that go on are the first ones
    pos = np.arange(n) - np.concatenate([[0], np.cumsum(length)])[doc]
    # tokens by their place in the text, then by text: a step of the recursions is one slice
    o = np.lexsort((rank[doc], pos))
    size = np.bincount(pos)
    at = np.concatenate([[0], np.cumsum(size)])
    back = np.empty(n, np.int64)
    back[o] = np.arange(n)
    final = back[np.cumsum(length) - 1]  # last tokens
    y = gold[o]
    # word beside each token, n_words where there is none; and its tokens in order, for the sums
    beside, order, first_of, has = [], [], [], []
    for k in OFFSETS:
        to = np.arange(n) + k
        ok = (to >= 0) & (to < n)
        ok[ok] = doc[to[ok]] == doc[ok]
        w = np.full(n, n_words)
        w[ok] = word[to[ok]]
        w = w[o]
        beside.append(w)
        order.append(np.argsort(w, kind="stable")[: int(ok.sum())])
        start = np.searchsorted(w[order[-1]], np.arange(n_words))
        full = np.flatnonzero(np.bincount(w, minlength=n_words + 1)[:n_words])
        has.append(full)
        first_of.append(start[full])
    g_gold = np.zeros((NL, NL))
    np.add.at(g_gold, (np.zeros(n_doc, int), y[: size[0]]), 1)
    np.add.at(g_gold, (y[final], np.zeros(n_doc, int)), 1)
    for t in range(1, len(size)):
        np.add.at(g_gold, (y[at[t - 1] : at[t - 1] + size[t]], y[at[t] : at[t + 1]]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, trans)]
    e_word = np.zeros((n_words + 1, len(OFFSETS) * NL), np.float32)
    g_word = np.zeros((n_words, len(OFFSETS) * NL), np.float32)
    alpha, beta = np.empty((n, NL), np.float32), np.empty((n, NL), np.float32)
    for step in range(1, rounds + 1):
        e_word[:-1] = np.add.reduceat(theta[ff], w_start, axis=0)
        em = sum(np.take(e_word[:, i * NL : (i + 1) * NL], w, axis=0) for i, w in enumerate(beside))
        x = np.exp(em - em.max(1, keepdims=True))
        et = np.exp(trans).astype(np.float32)
        for t, m in enumerate(size):
            a = (et[0][None] if t == 0 else alpha[at[t - 1] : at[t - 1] + m] @ et) * x[at[t] : at[t + 1]]
            alpha[at[t] : at[t + 1]] = a / a.sum(1, keepdims=True)
        g_tr = g_gold.copy()
        for t in range(len(size) - 1, -1, -1):
            m, more = size[t], size[t + 1] if t + 1 < len(size) else 0
            beta[at[t] + more : at[t + 1]] = et[:, 0]
            if more:
                right = x[at[t + 1] : at[t + 2]] * beta[at[t + 1] : at[t + 2]]
                b = right @ et.T
                beta[at[t] : at[t] + more] = b / b.sum(1, keepdims=True)
                left = alpha[at[t] : at[t] + more]
                g_tr -= ((left / (left * b).sum(1, keepdims=True)).T @ right) * et
        p = alpha * beta
        p /= np.maximum(p.sum(1, keepdims=True), 1e-30)
        g_tr[0] -= p[: size[0]].sum(0)
        g_tr[:, 0] -= p[final].sum(0)
        g_em = -p
        g_em[np.arange(n), y] += 1
        for i in range(len(OFFSETS)):
            g_word[has[i], i * NL : (i + 1) * NL] = np.add.reduceat(np.take(g_em, order[i], axis=0), first_of[i], axis=0)
        g_theta = np.add.reduceat(g_word[fw_s], f_start, axis=0)
        for k, (w, g) in enumerate(((theta, g_theta - penalty * theta), (trans, g_tr - penalty * trans))):
            m1, m2 = moments[k]
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            w += rate * (0.5 + 0.5 * np.cos(np.pi * step / (rounds + 1))) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    # words that stand in small letters or often in plain rows are no parts of names
    often: dict[str, int] = {}
    for t, spans in rows:
        if not spans:
            for w in set(re.findall(_NAME, t)):
                often[w.casefold()] = often.get(w.casefold(), 0) + 1
    plain = {w for w, n in often.items() if n >= 4} | {w for t, spans in rows if not spans for w in re.findall(_NAME, t) if w.islower()}
    return Crf(index, theta.astype(np.float32), trans.astype(np.float32), frozenset(plain - _GIVEN - {w.casefold() for w in SURNAMES}))


class Lexicon:
    """Words that are no parts of names: those of the labelled table, and hashes of those of the corpus."""

    def __init__(self, words: frozenset[str], hashes: np.ndarray):
        self.words, self.hashes, self.known = words, hashes, {}

    def __getstate__(self):
        return {"words": self.words, "hashes": self.hashes, "known": {}}

    def __contains__(self, w: str) -> bool:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            cp, _ = grams.code_points([w.lower()])
            h = _hashes(cp, np.array([0]), np.array([len(cp) - 1]))[0][0]
            at = int(np.searchsorted(self.hashes, h))
            got = self.known[w] = w in self.words or w not in _GIVEN and at < len(self.hashes) and self.hashes[at] == h
        return got


#: Words that count as plain: small in at least this share of their places and not rarer than LEAST among all words, or at least as frequent as OFTEN.
SMALL_SHARE, LEAST, OFTEN = 0.25, 1e-6, 1e-4


def plain_words(df: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the plain words of all texts of a table, in order. Words are counted by hash on the executors; by LEAST, at most a million are left for the driver."""

    def counts(batches):
        held, size = [], 0
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for a, b in grams.slices([len(t) for t in texts]):
                cp, _, s, e = tokenize(texts[a:b])
                at = np.minimum(cp, 0xFFFF)
                low = _table("lower", lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c))[at]
                letters = np.concatenate([[0], np.cumsum(_table("alpha", str.isalpha)[at])])
                small = np.concatenate([[0], np.cumsum(_table("islower", str.islower)[at])])
                ok = (letters[e] - letters[s] == e - s) & (e - s > 1)
                s, e = s[ok], e[ok]
                held.append((_hashes(low, s, e)[0], small[e] - small[s] == e - s))
                size += len(s)
                if size > 2_000_000:
                    yield _sums(held)
                    held, size = [], 0
        if held:
            yield _sums(held)

    rows = df.select(F.col(text_col).alias("text")).where("text is not null")
    n = rows.mapInArrow(counts, "h bigint, n bigint, small bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))
    n = materialize(n, "words")
    total = n.agg(F.sum("n")).first()[0] or 0
    kept = n.where((F.col("n") >= OFTEN * total) | ((F.col("small") > 1) & (F.col("small") >= SMALL_SHARE * F.col("n")) & (F.col("n") >= LEAST * total)))
    return np.sort(np.array([r.h for r in kept.select("h").collect()], np.int64).view(np.uint64))


def _sums(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h, small = (np.concatenate([x[i] for x in held]) for i in range(2))
    o = np.argsort(h)
    h, small = h[o], small[o].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    few = np.add.reduceat(small, at) if len(h) else small
    return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h)))), pa.array(few)], names=["h", "n", "small"])


@functools.lru_cache(maxsize=4)
def _trained(plain: tuple[str, ...]) -> Crf:
    return train(labelled_rows(plain=plain))


def fit_model(df: DataFrame | None = None, id_col: str = "", text_col: str = "", sample_texts: int = 700, plain_sentences: int = 2600) -> Crf:
    """Model from the labelled table.

    With a table of texts, ``plain_sentences`` sentences of ``sample_texts`` of
    its rows (the bound of the sample, chosen by the hash of the id) stand
    beside the frames as examples without personal data, and the lexicon of
    plain words comes from all of its rows.
    """
    if df is None:
        return _trained(())
    hashes = plain_words(df, text_col)
    rows = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    # the bound of the hashes first: texts of every task's best rows would all go to the driver
    last = rows.select("h").distinct().orderBy("h").limit(sample_texts).agg(F.max("h")).first()[0]
    few = rows.where(F.col("h") <= (0 if last is None else last)).distinct().limit(4 * sample_texts).collect()
    crf = _trained(tuple(clean_sentences(sorted({r.t for r in few}), plain_sentences, Lexicon(frozenset(), hashes))))
    return Crf(crf.index, crf.theta, crf.trans, Lexicon(crf.plain, hashes))


# The forms that an exact check demands of a span.
_NAME = r"[^\W\d_][^\W\d_'’-]+"
_TITLE = {"mr", "ms", "mrs", "dr", "frau", "herr", "mme", "mlle", "sr", "sra", "dhr", "mevr", "prof"}
_FIRM = {w.replace(".", "").casefold() for w in (*COMPANY, *SHORTENED)} | {"bv", "sa", "plc", "llc", "sarl", "kg", "ohg", "lda", "nv", "spa", "oy", "ab"}
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[,.&/\n]")
_GIVEN = {w.casefold() for w in (*GIVEN, *SHORT)}
_MAIL = re.compile(r"\w(?:[\w.+-]*)\s*(?:@|\(at\)|\[at\]|\bat\b|\[@\])\s*\w[\w-]*\s*(?:(?:\.|\s*\(dot\)\s*|\s*\[dot\]\s*|\s+dot\s+)[a-z]{2,})+", re.I)
_CODE = re.compile(r"^\(?[A-Z]{2}-\d{1,5}\)?$")


# What stands before a number that is an order's, an invoice's, a part's or a page's.
_THINGS = r"(?:order|invoice|part|item|ticket|case|batch|serial|shipment|tracking|reference|page|line|bestell\w*|rechnung\w*|lieferung|vorgang|teile?nummer|seite|zeile|commande|facture|dossier|pièce|ligne|pedido|factura|expediente|pieza|página|línea|bestelling|factuur\w*|zaak|onderdeel|pagina|regel|encomenda|fatura|processo|peça|linha|заказ|счёт|счет|дело|деталь|страница|строка)s?"
_THING = re.compile(rf"\b{_THINGS}\s+\d", re.I)
_OF_A_THING = re.compile(rf"\b{_THINGS}\s*(?:no|nr|num|number|nummer|n|nº|n\.º|n°|№)?\s*[.:º°#№]?\s*$", re.I)


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _name_span(text: str, a: int, b: int, plain) -> tuple[int, int] | None:
    """The whole name around a span, or None if it is none: a given name, initial or title beside a word that is not plain, and no firm. The text is read as far as the name goes."""
    width = 48
    while (got := _name_within(text, a, b, plain, max(0, a - width), min(len(text), b + width))) == "wider":
        width *= 4
    return got


def _name_within(text: str, a: int, b: int, plain, lo: int, hi: int) -> tuple[int, int] | None | str:
    near = [(m.start(), m.end(), m.group()) for m in _WORDS.finditer(text, lo, hi)]
    if lo and near and near[0][0] == lo and near[0][0] < a:
        near = near[1:]
    if hi < len(text) and near and near[-1][1] == hi and near[-1][1] > b:
        near = near[:-1]
    inside = [i for i, (x, y, w) in enumerate(near) if x < b and y > a and w not in ",.&/\n"]
    if not inside:
        return None

    def part(w: str) -> bool:
        if any(c.isdigit() for c in w):
            return False
        f = w.casefold()
        return f in _GIVEN or f.rstrip(".") in _TITLE or (len(w) == 1 and w.isupper()) or (w[0].isupper() and len(w) > 2 and f not in plain)

    inside = [i for i in inside if part(near[i][2])]
    if not inside:
        return None
    i, j = inside[0], inside[-1]
    grown = True
    while grown:  # over initials, titles, a comma or a full stop to the other parts of the name
        if lo and i < 3 or hi < len(text) and j > len(near) - 4:
            return "wider"
        grown = False
        if i > 0 and part(near[i - 1][2]):
            i, grown = i - 1, True
        elif i > 1 and near[i - 1][2] in ",." and part(near[i - 2][2]) and near[i][0] - near[i - 2][1] <= 3 and (near[i - 1][2] == "," and near[i][2].casefold() in _GIVEN or near[i - 1][2] == "." and (len(near[i - 2][2]) == 1 or near[i - 2][2].casefold() in _TITLE)):
            i, grown = i - 2, True
        if j + 1 < len(near) and part(near[j + 1][2]):
            j, grown = j + 1, True
        elif j + 2 < len(near) and part(near[j + 2][2]) and near[j + 2][0] - near[j][1] <= 3 and (near[j + 1][2] == "," and near[j + 2][2].casefold() in _GIVEN or near[j + 1][2] == "." and (len(near[j][2]) == 1 or near[j][2].casefold() in _TITLE)):
            j, grown = j + 2, True
    ws = [w for _, _, w in near[i : j + 1] if w not in ",.&/\n"]
    low = [w.casefold() for w in ws]
    if any(w in _FIRM for w in low):
        return None
    for k in (j + 1, j + 2):
        if k < len(near) and (near[k][2] == "&" or near[k][2].casefold() in _FIRM and near[k][2][0].isupper()) and near[k][0] - near[j][1] <= 3:
            return None
    if i and near[i - 1][2] == "&":
        return None
    given, mark, name = sum(w in _GIVEN for w in low), sum(w in _TITLE or len(w) == 1 for w in low), sum(len(w) > 2 and w not in _GIVEN and w not in _TITLE for w in low)
    both = sum(a <= x and y <= b + 1 and len(w) > 2 for x, y, w in (near[k] for k in range(i, j + 1)) if w not in ",.&/\n")
    if not (name and (given or mark) or name >= 2 and both >= 2 or given >= 2):
        return None
    return near[i][0], near[j][1]


def _number_span(text: str, a: int, b: int) -> tuple[int, int]:
    """The whole number around a span: groups of digits beside it with at most two separators between belong to it."""
    left = re.search(r"(?:\+?\(?\d{2,}\)?[ .()/-]{1,2})+$", text[max(0, a - 32) : a])
    right = re.match(r"(?:[ .()/-]{0,2}\d{2,})+", text[b : b + 32])
    return a - (len(left.group()) if left else 0), b + (right.end() if right else 0)


def _in_heading(text: str, a: int) -> bool:
    """Whether a place lies in a path of headings in brackets."""
    at = text.rfind("[", 0, a)
    end = text.find("]", at)
    return at >= 0 and end >= a and " > " in text[at:end]


def _mail_span(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The whole address around a span."""
    width = 48
    while True:
        lo, hi = max(0, a - width), min(len(text), b + width)
        m = next((m for m in _MAIL.finditer(text, lo, hi) if m.start() < b and m.end() > a), None)
        if m is None:
            return None
        if not (lo and m.start() == lo or hi < len(text) and m.end() >= hi - 1):
            return m.span()
        width *= 4


def checked(text: str, spans: list[tuple[int, int, str]], plain) -> list[tuple[int, int, str]]:
    """The spans that pass the exact check of their kind; names are completed; overlaps go to the earlier span."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        s = text[a:b]
        if kind == "person":
            got = _name_span(text, a, b, plain)
            if got is None or "@" in text[got[0] : got[1] + 1] or re.search(r"[@+._]$", text[max(0, got[0] - 1) : got[0]]):
                continue
            a, b = got
            if _in_heading(text, a) and not any(w.casefold() in _GIVEN or w.casefold() in _TITLE for w in re.findall(r"[^\W\d_]+", text[a:b])):
                continue  # documents are named by invented words too
        elif kind == "email":
            if (mail := _mail_span(text, a, b)) is None:
                continue
            a, b = mail
        elif kind in ("phone", "id_number"):
            a, b = _number_span(text, a, b)
            s = text[a:b]
            if _OF_A_THING.search(text[max(0, a - 40) : a]):
                continue
            if _digits(s) < (7 if kind == "phone" else 6) or _CODE.match(s) or re.search(r"[^\W\d]{4,}", s):
                continue
        elif not (_digits(s) and re.search(r"[^\W\d_]{4,}", s) and any(c.isupper() for c in s)) or len(s) < 10 or "_" in s or _THING.search(s) or _in_heading(text, a) or all(w.casefold() in plain for w in re.findall(r"[^\W\d_]{4,}", s)):
            got = _name_span(text, a, b, plain)  # a family name before a comma can look like a town
            if got is None or not any(w.casefold() in _GIVEN for w in re.findall(_NAME, text[got[0] : got[1]])):
                continue
            a, b, kind = *got, "person"
        if out and a < out[-1][1]:
            if out[-1][2] == kind:
                out[-1] = (out[-1][0], max(b, out[-1][1]), kind)
            continue
        out.append((a, b, kind))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind's placeholder."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(df: DataFrame, id_col: str, text_col: str, model: Crf | None = None, masked: bool = False) -> DataFrame:
    """One row per non-null text: (id, kinds, spans, masked).

    ``kinds`` are the different kinds found, ``spans`` are structs (start_char,
    end_char, kind), ``masked`` is the text with placeholders, or null if not
    asked for.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    shared = df.sparkSession.sparkContext.broadcast(model or fit_model())  # bounded by the labelled table

    span = pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("kind", pa.string())])

    def run(batches):
        crf = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in grams.slices([len(t) for t in texts]):
                part = texts[a:b]
                d, s, e, k = crf.spans(part)
                found: list[list] = [[] for _ in part]
                for x, y, z, w in zip(d.tolist(), s.tolist(), e.tolist(), k.tolist()):
                    found[x].append((y, z, KINDS[w]))
                found = [checked(t, f, crf.plain) if f else f for t, f in zip(part, found)]
                out = [pa.array([mask(t, f) for t, f in zip(part, found)]) if masked else pa.nulls(b - a, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([sorted({z for *_, z in f}) for f in found], pa.list_(pa.string())), pa.array([[dict(zip(("start_char", "end_char", "kind"), x)) for x in f] for f in found], pa.list_(span)), *out], names=["id", "kinds", "spans", "masked"])

    return rows.mapInArrow(run, "id string, kinds array<string>, spans array<struct<start_char:int,end_char:int,kind:string>>, masked string")
