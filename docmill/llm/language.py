"""Language of texts and of their segments, by character language models.

One interpolated Kneser-Ney model per language over the characters of words
(each padded by a blank), fitted on a bounded sample of labelled rows. All
models are stored together in sorted hash arrays: one array of n-gram hashes
per order with the log probabilities of all languages beside it, one array of
context hashes with the back-off weights. A text's language is the one of the
lowest cross-entropy per character; values above a limit calibrated on held-out
rows are rejected ("und").

Sentences end at line feeds and at . ! ? before white space. A sentence with
fewer than ``MIN_WORDS`` words without digits has no language of its own.
Segments are maximal runs of sentences of one language; a language other than
the main one counts only with a run of ``MIN_RUN`` sentences.

Null texts give no row; empty texts and texts without words give one row with
lang "und" and confidence 0. Ties go to the language that is first in the
model. Each input row is treated alone, so repeated rows give repeated rows.
Whole texts are used whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import grams
from docmill.llm.near_duplicates import _spread

_U = np.uint64
#: The codes of this project's languages; others are a parameter of ``label_code`` and ``fit_language_model``.
LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru")
ORDER = 4
DISCOUNT = 0.75
#: Different characters that the uniform distribution below the unigrams spreads over.
ALPHABET = 300
MIN_WORDS, MIN_RUN = 4, 2
#: Nats per word by which a segment's language must be ahead of the main one.
MARGIN = 0.35
#: Share of the log-likelihood that counts as evidence; neighbouring characters depend on each other.
TEMPER = 0.25
_WORDS = re.compile(r"[^\W_]+")
_LABEL = r"^[A-Za-z]{2}([-_][A-Za-z]{2})?$"


def label_code(col, languages: tuple[str, ...] = LANGUAGES):
    """The one of the languages that a label names in any letter case and with any region, or null."""
    s = F.trim(col)
    code = F.lower(F.substring(s, 1, 2))
    return F.when(s.rlike(_LABEL) & code.isin(*languages), code)


def _gram_hash(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each position; positions before k - 1 hold nothing of use."""
    out = np.zeros(len(cp), np.uint64)
    for back in range(k - 1, -1, -1):
        c = np.roll(cp, back).astype(np.uint64)
        out = grams.mix(out * _U(0xD6E8FEB86659FD93) + c + _U(k))
    return out


class LanguageModel:
    """Sorted hash arrays of all languages' models."""

    def __init__(self, languages, keys, logp, ctx, back, uniform, limit=math.inf):
        self.languages, self.keys, self.logp, self.ctx, self.back, self.uniform, self.limit = list(languages), keys, logp, ctx, back, uniform, limit
        self.known = np.zeros(0, np.uint64)
        self.score = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "score")} | {"known": np.zeros(0, np.uint64), "score": np.zeros((0, len(self.languages)), np.float32)}

    @staticmethod
    def fit(counts: dict[str, dict[str, int]]) -> LanguageModel:
        """From the words' counts of each language."""
        langs = sorted(counts)
        grams_of, n_lang = [], len(langs)
        for lang in langs:
            raw: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
            for w, n in counts[lang].items():
                s = " " + w + " "
                for i in range(1, len(s)):  # the leading blank is given
                    g = s[max(0, i - ORDER + 1) : i + 1]
                    raw[len(g)][g] = raw[len(g)].get(g, 0) + n
            # lower orders count in how many different left contexts an n-gram stands, or times for those at a word's start
            for k in range(ORDER, 1, -1):
                for g in raw[k]:
                    raw[k - 1][g[1:]] = raw[k - 1].get(g[1:], 0) + 1
            grams_of.append(raw)
        keys, logp, ctxs, backs = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
        lower: list[dict[str, float]] = [{} for _ in langs]
        uniform = 1.0 / ALPHABET
        for k in range(1, ORDER + 1):
            ctx = [{} for _ in langs]
            for x, raw in enumerate(grams_of):
                for g, n in raw[k].items():
                    t = ctx[x].setdefault(g[:-1], [0.0, 0])
                    t[0] += n
                    t[1] += 1
            every = sorted(set().union(*[raw[k] for raw in grams_of]))
            every_ctx = sorted(set().union(*ctx))
            lam = [{c: DISCOUNT * t[1] / t[0] for c, t in ctx[x].items()} for x in range(n_lang)]
            now: list[dict[str, float]] = [{} for _ in langs]
            p = np.empty((len(every), n_lang), np.float32)
            for i, g in enumerate(every):
                for x, raw in enumerate(grams_of):
                    below = self_lower(lower[x], lam_prev[x], g[1:], uniform) if k > 1 else uniform
                    t = ctx[x].get(g[:-1])
                    v = below if t is None else max(raw[k].get(g, 0) - DISCOUNT, 0) / t[0] + lam[x][g[:-1]] * below
                    now[x][g] = v
                    p[i, x] = math.log(v)
            h = _hash_strings(every, k)
            o = np.argsort(h)
            keys[k], logp[k] = h[o], p[o]
            hc = _hash_strings(every_ctx, k - 1) if k > 1 else np.zeros(1, np.uint64)
            oc = np.argsort(hc)
            ctxs[k], backs[k] = hc[oc], np.log(np.array([[lam[x].get(c, 1.0) for x in range(n_lang)] for c in every_ctx], np.float32))[oc]
            lower, lam_prev = now, lam
        return LanguageModel(langs, keys, logp, ctxs, backs, math.log(uniform))

    def _char_scores(self, cp: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Log probabilities (characters x languages). depth: characters since the word's leading blank, that one being 0."""
        n = len(cp)
        out = np.zeros((n, len(self.languages)), np.float32)
        todo = np.flatnonzero(depth > 0)
        hashes = {k: _gram_hash(cp, k) for k in range(1, ORDER + 1)}
        for k in range(ORDER, 0, -1):
            can = todo[depth[todo] >= k - 1]
            at = np.searchsorted(self.keys[k], hashes[k][can])
            at[at == len(self.keys[k])] = 0
            hit = self.keys[k][at] == hashes[k][can]
            out[can[hit]] += self.logp[k][at[hit]]
            miss = can[~hit]
            if k > 1:
                prev = hashes[k - 1][miss - 1]
                c = np.searchsorted(self.ctx[k], prev)
                c[c == len(self.ctx[k])] = 0
                seen = self.ctx[k][c] == prev
                out[miss[seen]] += self.back[k][c[seen]]
            else:
                out[miss] += self.back[1][0] + self.uniform
            todo = np.concatenate([todo[depth[todo] < k - 1], miss])
        return out

    def word_scores(self, h: np.ndarray, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Log-likelihood (words x languages) of the words cp[s:e] with hashes h."""
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, u)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            a, n = s[first[new]], (e - s)[first[new]] + 2
            depth = _spread(np.zeros(len(new), np.int64), n)
            src = np.repeat(a, n) + depth - 1
            chars = np.where((depth == 0) | (depth == np.repeat(n, n) - 1), 32, cp[np.clip(src, 0, len(cp) - 1)])
            sums = np.add.reduceat(self._char_scores(chars.astype(np.uint64), depth), np.cumsum(n) - n, axis=0)
            if len(self.known) > 400_000:
                self.known, self.score = u[:0], sums[:0]
                return self.word_scores(h, cp, s, e)
            known = np.concatenate([self.known, u[new]])
            score = np.concatenate([self.score, sums])
            o = np.argsort(known, kind="stable")
            self.known, self.score = known[o], score[o]
        return self.score[np.searchsorted(self.known, u)][inv]

    def sentences(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Sentences of the texts: doc, start, end (in the text), words, characters and the log-likelihoods."""
        low = [t.lower() for t in texts]
        keep = [x if len(x) == len(t) else t for x, t in zip(low, texts)]  # offsets must be those of the text
        cp, starts = grams.code_points(keep)
        orig = cp if keep is texts else grams.code_points(texts)[0]
        h, doc, s, e = grams.words(keep) if all(len(x.lower()) == len(x) for x in keep) else _words_as_they_are(keep)
        n = len(cp)
        nxt, nxt2 = np.append(cp[1:], 10), np.append(orig[2:], [10, 10])
        stop = ((cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x2026)) & ((nxt == 32) | (nxt == 10) | (nxt == 9))
        long_before = np.zeros(n + 1, bool)
        long_before[e[(e - s) > 4]] = True
        cased = _upper(nxt2)
        brk = np.flatnonzero((stop & (cased | long_before[:n] | (nxt == 10))) | (cp == 10)) + 1
        bounds = np.unique(np.concatenate([[0], brk, starts]))
        bounds = bounds[bounds <= n]
        sent = np.searchsorted(bounds, s, side="right") - 1
        digit = np.zeros(n + 1, np.int32)
        digit[1:] = np.cumsum((cp >= 48) & (cp <= 57))
        ok = digit[e] == digit[s]
        m = len(bounds) - 1
        lik = np.zeros((m, len(self.languages)))
        if ok.any():
            sc = self.word_scores(h[ok], cp, s[ok], e[ok])
            for x in range(len(self.languages)):
                lik[:, x] = np.bincount(sent[ok], weights=sc[:, x], minlength=m)
        nw = np.bincount(sent[ok], minlength=m)
        nc = np.bincount(sent[ok], weights=(e - s + 1)[ok], minlength=m).astype(np.int64)
        d = np.searchsorted(starts, bounds[:-1], side="right") - 1
        return {"doc": d, "start": bounds[:-1] - starts[d], "end": np.minimum(bounds[1:], starts[d + 1] - 1) - starts[d], "words": nw, "chars": nc, "lik": lik}

    def segments(self, texts: list[str]) -> pd.DataFrame:
        """One row per segment: doc, seg, start, end, lang, confidence, n_sentences, main (of the text), text_lang."""
        q = self.sentences(texts)
        nd, nl = len(texts), len(self.languages)
        doc_lik, doc_c, doc_w = np.zeros((nd, nl)), np.bincount(q["doc"], weights=q["chars"], minlength=nd), np.bincount(q["doc"], weights=q["words"], minlength=nd)
        best = np.argmax(q["lik"], 1)
        long = (q["words"] >= MIN_WORDS) & (-q["lik"].max(1) <= self.limit * np.maximum(q["chars"], 1))
        # the main language has most of the words of sentences with a language; without any, the whole text decides
        share = np.zeros((nd, nl))
        np.add.at(share, (q["doc"][long], best[long]), q["words"][long])
        for x in range(nl):
            doc_lik[:, x] = np.bincount(q["doc"], weights=q["lik"][:, x], minlength=nd)
        main = np.where(share.sum(1) > 0, np.argmax(share + 1e-9 * np.exp((doc_lik - doc_lik.max(1, keepdims=True)) * 0.01), 1), np.argmax(doc_lik, 1))
        und = (doc_w == 0) | ((share.sum(1) == 0) & (-doc_lik.max(1) > self.limit * np.maximum(doc_c, 1)))
        ahead = q["lik"][np.arange(len(best)), best] - q["lik"][np.arange(len(best)), main[q["doc"]]]
        lang = np.where(long & ((ahead > MARGIN * q["words"]) | (best == main[q["doc"]])), best, -1)
        # runs over the sentences with a language; the others belong to the run before them
        idx = np.flatnonzero(lang >= 0)
        out = []
        d, g = q["doc"][idx], lang[idx]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])) if len(idx) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(idx)))
        keep = (size >= MIN_RUN) | (g[cut] == main[d[cut]]) if len(cut) else np.zeros(0, bool)
        # short foreign runs melt into the main language
        merged = np.where(np.repeat(keep, size), g, main[d]) if len(idx) else g
        per: dict[int, list[tuple[int, int]]] = {}
        for i, x, l in zip(idx.tolist(), d.tolist(), merged.tolist()):
            per.setdefault(x, []).append((i, l))
        for x in range(nd):
            runs: list[list] = []
            for i, l in per.get(x, []):
                if runs and runs[-1][0] == l:
                    runs[-1][1].append(i)
                else:
                    runs.append([l, [i]])
            if not runs:
                runs = [[int(main[x]), []]]
            for k, (l, at) in enumerate(runs):
                lik = q["lik"][at].sum(0) if at else doc_lik[x]
                conf = float(np.exp(TEMPER * (lik[l] - lik.max())) / np.exp(TEMPER * (lik - lik.max())).sum())
                a = 0 if k == 0 else int(q["start"][at[0]])
                b = len(texts[x]) if k == len(runs) - 1 else int(q["start"][runs[k + 1][1][0]])
                name = "und" if und[x] else self.languages[l]
                out.append((x, k, a, b, name, 0.0 if und[x] else round(conf, 6), len(at), l == main[x]))
        return pd.DataFrame(out, columns=["doc", "seg", "start_char", "end_char", "lang", "confidence", "n_sentences", "is_main"])

    def calibrate(self, texts: list[str], labels: list[str], quantile: float = 0.999, slack: float = 1.15) -> LanguageModel:
        """Set the rejection limit from held-out sentences in their own language."""
        q = self.sentences(texts)
        own = np.array([self.languages.index(x) for x in labels])[q["doc"]]
        ok = q["words"] >= MIN_WORDS
        h = -q["lik"][np.flatnonzero(ok), own[ok]] / q["chars"][ok]
        self.limit = float(np.quantile(h, quantile) * slack) if len(h) else math.inf
        return self


def self_lower(lower: dict, lam: dict, g: str, uniform: float) -> float:
    """p of the shorter n-gram g in one language, by its own back-off where it was not seen."""
    v = lower.get(g)
    return v if v is not None else lam.get(g[:-1], 1.0) * uniform


def _hash_strings(gs: list[str], k: int) -> np.ndarray:
    cp = np.frombuffer("".join(gs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _gram_hash(cp, k)[k - 1 :: k]


def _upper(cp: np.ndarray) -> np.ndarray:
    st = grams._state
    if "upper" not in st:
        st["upper"] = np.array([chr(i).isupper() for i in range(0x10000)])
    return st["upper"][np.minimum(cp, 0xFFFF)]


def _words_as_they_are(texts: list[str]):
    """Words of texts in which lower-casing changes offsets."""
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    hs, ds, ss, es, at = [], [], [], [], 0
    for i, t in enumerate(low):
        for m in _WORDS.finditer(t):
            hs.append(int.from_bytes(hashlib.blake2b(m.group().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
            ds.append(i)
            ss.append(at + m.start())
            es.append(at + m.end())
        at += len(t) + 1
    return np.array(hs, np.uint64), np.array(ds, np.int64), np.array(ss, np.int64), np.array(es, np.int64)


def fit_language_model(labelled: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = 150, languages: tuple[str, ...] = LANGUAGES) -> LanguageModel:
    """Model from at most ``per_language`` rows of each language (the bound of the sample, chosen by the hash of the id), a third of them for the calibration."""
    rows = labelled.select(F.col(text_col).alias("text"), label_code(F.col(label_col), languages).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).where("lang is not null and text is not null")
    # ranks over hashes alone; only the texts below each language's last hash are moved
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = rows.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    few = rows.join(F.broadcast(last), "lang").where("h <= last").select("lang", "h", "text").toPandas().sort_values(["lang", "h", "text"])
    few = few.assign(r=few.groupby("lang").cumcount()).query("r < @per_language")
    counts: dict[str, dict[str, int]] = {}
    for lang, text in few[few.r % 3 != 0][["lang", "text"]].itertuples(index=False):
        c = counts.setdefault(lang, {})
        for w in _WORDS.findall(text.lower()):
            if not any(ch.isdigit() for ch in w):
                c[w] = c.get(w, 0) + 1
    if not counts:
        raise ValueError("no labelled rows to fit the language models on")
    held = few[(few.r % 3 == 0) & few.lang.isin(list(counts))]
    return LanguageModel.fit(counts).calibrate(held.text.tolist(), held.lang.tolist())


def identify(df: DataFrame, id_col: str, text_col: str, model: LanguageModel, *keep: str) -> DataFrame:
    """Segments of every non-null text: (id, keep…, seg, start_char, end_char, lang, confidence, n_sentences, is_main)."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)], F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in grams.slices([len(t) for t in texts]):
                out = m.segments(texts[a:b])
                at = pa.array(a + out.doc.to_numpy())
                cols = [batch.column(i).take(at) for i in range(1 + len(keep))]
                cols += [pa.array(out[c], ty) for c, ty in (("seg", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("is_main", pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", *[f"keep_{i}" for i in range(len(keep))], "seg", "start_char", "end_char", "lang", "confidence", "n_sentences", "is_main"])

    kinds = ", ".join(["id string", *[f"keep_{i} {rows.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep))]])
    out = rows.mapInArrow(run, kinds + ", seg int, start_char int, end_char int, lang string, confidence double, n_sentences int, is_main boolean")
    for i, k in enumerate(keep):
        out = out.withColumnRenamed(f"keep_{i}", k)
    return out
