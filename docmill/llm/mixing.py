"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. The total is the largest in which
every weighted source that has documents reaches its share with at most its
number of repeats (or a given total, where a source that cannot reach its share
gives all it may and the others share what is left by their weights).

Each pass over a source has an order of its own, by a hash of seed, pass and
id. The quota takes whole passes and, of one more, the documents up to a cut
that is found by halving the hash range (by 1024 at a time): no task and no
driver ever holds a source. The order is cut into blocks of about
``shard_tokens`` / 16 tokens, whose numbers are permuted. A splitting tree deals the blocks
to output shards: at each node the number of blocks of every source that go
left is drawn from the multivariate hypergeometric distribution, so every shard
is a fair draw and the counts add up exactly. The driver draws the top
``SUBTREES`` nodes, the executors the subtrees below them. Shards are shuffled
locally by a hash of seed, document and pass.

Null sources, sources without a weight and documents without tokens (null or
empty texts) are not used; a weighted source without documents gets nothing
and its share goes to the others in proportion. Weights that are null or not
positive count as none, null repeats as 1. Rows repeated with the same id
count once. Ties are broken by the id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import grams
from docmill.llm.common import once
from docmill.storage import materialize

#: Blocks of a shard, about; nodes of the splitting tree that the driver draws; bins that a hash range is cut into, and its bits.
BLOCKS, SUBTREES, BINS, BITS = 16, 1024, 1024, 50


def token_sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str) -> DataFrame:
    """(id, source, n_tokens) of every non-null text."""
    rows = once(df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("text is not null"), "id", "source", "text")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in grams.slices([len(t) for t in texts], 300_000):
                n = [len(e.ids) for e in tok.encode_batch_fast(texts[a:b], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("source").slice(a, b - a), pa.array(n, pa.int64())], names=["id", "source", "n_tokens"])

    return rows.mapInArrow(run, "id string, source string, n_tokens bigint")


@dataclass
class Quota:
    """What a source gives: passes over all its documents, and tokens of one more pass."""

    source: str
    weight: float
    repeats: int
    tokens: int
    docs: int
    target: float
    passes: int = 0
    rest: int = 0


def quotas(weights: list[tuple[str, float, int]], sizes: dict[str, tuple[int, int]], total: float | None = None) -> list[Quota]:
    """Quotas of the weighted sources from {source: (tokens, documents)}; the rounding is down to whole tokens."""
    ws = [(s, float(w), max(1, int(r or 1))) for s, w, r in weights if s is not None and w is not None and w > 0]
    out = [Quota(s, w, r, *sizes.get(s, (0, 0)), 0.0) for s, w, r in ws]
    live = [q for q in out if q.tokens]
    if not live:
        return out
    share = sum(q.weight for q in live)
    full = min(q.tokens * q.repeats / (q.weight / share) for q in live)
    left, open_ = full if total is None else float(total), list(live)
    while open_:  # sources at their cap first; the rest by weight
        part = sum(q.weight for q in open_)
        over = [q for q in open_ if left * q.weight / part > q.tokens * q.repeats * (1 + 1e-12)]
        for q in over or open_:
            q.target = float(q.tokens * q.repeats) if over else left * q.weight / part
        if not over:
            break
        left -= sum(q.target for q in over)
        open_ = [q for q in open_ if q not in over]
    for q in live:
        want = min(int(q.target + 1e-6), q.tokens * q.repeats)
        q.passes, q.rest = divmod(want, q.tokens)
    return out


def _draw(n: np.ndarray, lo: int, hi: int, seed: int) -> tuple[int, np.ndarray]:
    """Middle of the shards lo to hi, and the blocks of each source that go to its left; the same whoever draws it."""
    mid = (lo + hi) // 2
    total = int(n.sum())
    take = total * (mid - lo) // (hi - lo)
    rng = np.random.default_rng([seed, lo, hi])
    return mid, rng.multivariate_hypergeometric(n, take, method="marginals") if total else n


def split_shards(counts: np.ndarray, lo: int, hi: int, seed: int, first: np.ndarray | None = None, leaves: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, first block of each source, blocks of each source) of the nodes below a node: the shards themselves, or about ``leaves`` nodes above them."""
    nodes = [(lo, hi, np.zeros(len(counts), np.int64) if first is None else first, counts.astype(np.int64))]
    while any(b - a > 1 for a, b, *_ in nodes) and (leaves is None or len(nodes) < leaves):
        below = []
        for a, b, f, n in nodes:
            if b - a == 1:
                below.append((a, b, f, n))
                continue
            mid, left = _draw(n, a, b, seed)
            below += [(a, mid, f, left), (mid, b, f + left, n - left)]
        nodes = below
    return nodes


def splitting_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) block counts: each node draws its left part's blocks without replacement."""
    return np.stack([n for *_, n in split_shards(counts, 0, shards, seed)])


def _place(seed: int):
    """A document's place in the order of a pass, from 0 to 2**BITS - 1."""
    return F.xxhash64(F.lit(seed), "id", "pass").bitwiseAND(F.lit((1 << BITS) - 1))


def find_cuts(sized: DataFrame, rests: dict[str, tuple[int, int]], seed: int) -> dict[str, int]:
    """For {source: (pass, tokens)} the place up to which the pass's documents have that many tokens, to the nearest document. Each round the driver gets at most BINS sums a source."""
    spark = sized.sparkSession
    at = {s: (0, 0) for s in rests}  # start of the range, tokens before it
    cuts: dict[str, int] = {}
    for bits in range(BITS - 10, -1, -10):
        if not at:
            break
        q = spark.createDataFrame([(s, rests[s][0], lo) for s, (lo, _) in at.items()], "source string, pass int, lo bigint")
        rows = sized.join(F.broadcast(q), "source").withColumn("h", _place(seed)).where(f"h >= lo and h < lo + {1 << (bits + 10)}")
        bins = rows.groupBy("source", F.shiftright(F.col("h") - F.col("lo"), bits).alias("bin")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).collect()
        by: dict[str, list] = {}
        for r in bins:
            by.setdefault(r.source, []).append(r)
        for s, (lo, run) in list(at.items()):
            del at[s]
            cuts[s] = lo + (1 << (bits + 10))
            for r in sorted(by.get(s, []), key=lambda r: r.bin):
                start, t = lo + (int(r.bin) << bits), int(r.t)
                if run + t > rests[s][1]:
                    if r.c > 1 and bits:
                        at[s] = (start, run)
                    else:
                        cuts[s] = start + (1 << bits if run + t / 2 <= rests[s][1] else 0)
                    break
                run += t
    return cuts


def _stride(n: int) -> int:
    """A number without a common divisor with n, near the golden section of it."""
    a = max(1, int(n * 0.618))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _ranges(sources: list[str], seed: int):
    """Subtrees (lo, hi, first, n) -> (source, first, last, shard): the permuted blocks that each shard draws."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for lo, _, first, n in split_shards(np.array(r.n, np.int64), r.lo, r.hi, seed, np.array(r.first, np.int64)):
                    out += [(sources[i], int(first[i]), int(first[i] + n[i] - 1), lo) for i in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=["source", "first", "last", "shard"])

    return run


def mix_sources(docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, total_tokens: int | str | None = None, shards: int | None = None, shard_tokens: int = 2_000_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: (doc_id, source, repeat_no, n_tokens, shard, position), one row for
    each use of a document. shares: (source, target_weight, max_repeats,
    available_tokens, target_tokens, tokens, share, docs, uses, most_repeats).
    ``total_tokens`` is the total aimed at, "available" for as many tokens as
    the weighted sources hold, or None for the largest total with exact shares.
    """
    spark = docs.sparkSession
    sized = materialize(token_sizes(docs, id_col, text_col, source_col, tokenizer).where("n_tokens > 0"), "sizes")
    # the list of sources is a setting; only its sources' sums reach the driver
    want = weights.where("source is not null").groupBy("source").agg(F.min("target_weight").alias("w"), F.min("max_repeats").alias("r")).collect()
    sums = sized.join(F.broadcast(spark.createDataFrame([(r.source,) for r in want], "source string")), "source").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d")).collect()
    if total_tokens == "available":
        total_tokens = sum(int(r.t) for r in sums)
    plan = quotas([(r.source, r.w, r.r) for r in sorted(want, key=lambda r: r.source)], {r.source: (int(r.t), int(r.d)) for r in sums}, total_tokens)
    used = [q for q in plan if q.passes or q.rest]
    size = sum(q.passes * q.tokens + q.rest for q in used)
    shards = shards or max(1, math.ceil(size / shard_tokens))
    cuts = find_cuts(sized, {q.source: (q.passes, q.rest) for q in used if q.rest}, seed)
    each = max(1.0, size / shards / BLOCKS)
    table, counts = [], []
    for q in used:  # blocks of a whole pass, of the last one, and of both
        whole, last = max(1, round(q.tokens / each)), max(1, round(q.rest / each)) if q.rest else 0
        counts.append(q.passes * whole + last)
        table.append((q.source, q.passes, cuts.get(q.source, 0), whole, last, counts[-1], _stride(counts[-1])))
    q = spark.createDataFrame(table, "source string, passes int, cut bigint, whole bigint, last bigint, all bigint, stride bigint")
    rows = sized.join(F.broadcast(q), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("last") > 0, 0).otherwise(1)))).withColumn("h", _place(seed))
    part = F.col("pass") == F.col("passes")
    rows = rows.where(~part | (F.col("h") < F.col("cut")))
    # place / range * blocks, in whole numbers: 50 bits and the blocks fit into a decimal
    number = lambda range_, n: F.floor(F.col("h").cast("decimal(20,0)") * n.cast("decimal(12,0)") / range_.cast("decimal(20,0)")).cast("bigint")
    blk = F.col("pass") * F.col("whole") + F.when(part, number(F.greatest("cut", F.lit(1)), F.col("last"))).otherwise(number(F.lit(1 << BITS), F.col("whole")))
    rows = rows.withColumn("blk", F.pmod(blk * F.col("stride"), F.col("all"))).select("id", "source", "pass", "n_tokens", "blk")
    nodes = split_shards(np.array(counts), 0, shards, seed, leaves=SUBTREES) if used else []
    sub = spark.createDataFrame([(lo, hi, f.tolist(), n.tolist()) for lo, hi, f, n in nodes], "lo long, hi long, first array<long>, n array<long>").repartition(max(1, min(len(nodes), SUBTREES // 4)))
    dealt = sub.mapInPandas(_ranges([s.source for s in used], seed), "source string, first long, last long, shard long").select("source", "shard", F.explode(F.sequence("first", "last")).alias("blk"))
    rows = rows.join(dealt, ["source", "blk"]).withColumn("shard", F.col("shard").cast("int"))
    mixture = rows.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "id", "pass"), "id", "pass"))).select(F.col("id").alias("doc_id"), "source", (F.col("pass") + 1).alias("repeat_no"), "n_tokens", "shard", "position")
    mixture = materialize(mixture, "mixture")
    got = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"), F.sum("c").alias("uses"), F.max("c").alias("most_repeats"))
    every = spark.createDataFrame([(p.source, p.weight, p.repeats, p.tokens, p.target) for p in plan], "source string, target_weight double, max_repeats int, available_tokens bigint, target_tokens double")
    reached = mixture.agg(F.sum("n_tokens")).first()[0] or 1
    shares = every.join(got, "source", "left").withColumn("all", F.lit(reached)).select("source", "target_weight", "max_repeats", "available_tokens", "target_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return mixture, shares
