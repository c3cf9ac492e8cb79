"""Reciprocal rank fusion, de-duplication and weighted selection of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, k: int = RRF_K, keep: list[str] | None = None) -> DataFrame:
    """Fuse (list_id, rank from 0, chunk_id, payload…): sum of 1/(k+rank+1), payload of the first list that holds the chunk.

    Blank ids use up their rank and are dropped. The terms are added in list
    order, so the sum is the same on every run.
    """
    keep = keep or []
    rows = lists.where("chunk_id is not null and chunk_id <> ''")
    terms = F.array_sort(F.collect_list(F.struct("list_id", "rank")))
    g = rows.groupBy("chunk_id").agg(terms.alias("t"), F.min(F.struct("list_id", "rank")).alias("first"), *[F.min_by(c, F.struct("list_id", "rank")).alias(c) for c in keep])
    score = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (F.lit(float(k + 1)) + x["rank"]))
    return g.select("chunk_id", score.alias("score"), "first", *keep)


def ordered(fused: DataFrame, limit: int | None = None) -> DataFrame:
    out = fused.orderBy(F.col("score").desc(), F.col("first.list_id"), F.col("first.rank"), "chunk_id")
    return out if limit is None else out.limit(limit)


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First arrival of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*key, "v.*")


def weighted_selection(sources: DataFrame, top_k: int, least: int = 1) -> DataFrame:
    """Chunks of ranked sources by linearly falling quotas.

    ``sources``: (source_rank from 0, chunk_ids array). With n sources the
    budget is max(top_k, n*least), the weight of source i is n-i, its quota
    max(least, weight/all*budget rounded down). Each source in turn takes its
    first ids that are not taken, most frequent ids over all sources first.
    Returns (rank, chunk_id). The fold runs over the sources of one query.
    """
    freq = sources.select(F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("f"))
    pos = sources.select("source_rank", F.posexplode("chunk_ids").alias("p", "chunk_id")).join(freq, "chunk_id")
    ranked = pos.groupBy("source_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("f")).alias("f"), "p", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return _quotas(ranked, top_k, least)


def weighted_rows(rows: DataFrame, top_k: int, most: int, least: int = 1) -> DataFrame:
    """``weighted_selection`` of different (source_rank, chunk_id) rows, ids ascending within each of at most ``most`` sources.

    Frequencies count all rows. The quotas add up to at most the budget plus
    most*least, so no source can give an id beyond that place: a hot source's
    other ids are left out before its list is put together, which is exact.
    """
    rows = rows.where("chunk_id is not null")
    freq = rows.groupBy("chunk_id").agg(F.count("*").alias("f"))
    best = Window.partitionBy("source_rank").orderBy(F.col("f").desc(), "chunk_id")
    first = rows.join(freq, "chunk_id").withColumn("p", F.row_number().over(best)).where(F.col("p") <= max(top_k, most * least) + most * least)
    ranked = first.groupBy("source_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return _quotas(ranked, top_k, least)


def _quotas(ranked: DataFrame, top_k: int, least: int) -> DataFrame:
    """The fold of the selection over (source_rank, ids in order of choice)."""
    all_ = ranked.agg(F.array_sort(F.collect_list(F.struct("source_rank", "ids"))).alias("s"))
    n = F.size("s")
    budget = F.greatest(F.lit(top_k), n * least)
    weight = lambda i: F.greatest(F.lit(1), n - i)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + weight(i))
    quota = lambda i: F.greatest(F.lit(least), F.floor(weight(i) / total * budget).cast("int"))
    taken = F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<string>"), lambda acc, i: F.concat(acc, F.slice(F.array_except(F.element_at("s", i + 1)["ids"], acc), F.lit(1), quota(i))))
    return all_.where(n > 0).select(F.posexplode(taken).alias("rank", "chunk_id"))


def budget_prefix(df: DataFrame, cost: str, budget: int, part: list[str], order: list, least: int | None = None) -> DataFrame:
    """Items in order until the cost would pass the budget; costs are not negative, so the running sum decides.

    Where no item costs less than ``least``, only the first budget / least can
    fit; without a partition they are then taken by a top-k and no sort of all.
    """
    if least and not part:
        df = df.orderBy(*order).limit(budget // least + 1)
    run = F.sum(cost).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")
