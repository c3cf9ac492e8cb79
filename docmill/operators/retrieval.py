"""Retrieval modes over a namespace's tables: local, global, hybrid, mix, naive; and their fusion over several namespaces."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import fusion
from docmill.operators.bm25 import bm25_phrase
from docmill.operators.graph import expand_communities, incident_edges
from docmill.operators.vector import vector_topk

MODES = ("local", "global", "hybrid", "mix", "naive", "bypass")


@dataclass
class Index:
    """The tables of one namespace, or of several with the namespace as a column."""

    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entity_chunks: DataFrame
    relation_chunks: DataFrame
    chunk_vectors: DataFrame
    entity_vectors: DataFrame
    relation_vectors: DataFrame
    communities: DataFrame | None = None
    rrf_k: int = fusion.RRF_K


@dataclass
class Result:
    chunks: DataFrame
    entities: DataFrame | None = None
    relations: DataFrame | None = None


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """Ranks of a top-k list; its size is bounded by k."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def _known(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids that are live chunks, first occurrence, ranks renewed."""
    one = ranked.groupBy("chunk_id").agg(F.min("rank").alias("rank"))
    # at most k ids meet the table; the different ones are told apart after that
    return _ranked(chunks.select("chunk_id").join(F.broadcast(one), "chunk_id").distinct(), ["rank"])


def _lists(*ls: DataFrame) -> DataFrame:
    u = None
    for i, x in enumerate(ls):
        one = x.select(F.lit(i).alias("list_id"), F.col("rank").cast("int").alias("rank"), "chunk_id")
        u = one if u is None else u.unionByName(one)
    return u


def _fuse(k: int, *ls: DataFrame) -> DataFrame:
    f = fusion.rrf(_lists(*ls), k)
    return _ranked(f, [F.col("score").desc(), F.col("first.list_id"), F.col("first.rank"), "chunk_id"]).select("rank", "chunk_id", F.round("score", 9).alias("score"))


def _bm25(ix: Index, query: str, k: int) -> DataFrame:
    return _known(_ranked(bm25_phrase(ix.chunks, query, k), ["score", "chunk_id"]).select("chunk_id", "rank"), ix.chunks)


def naive(ix: Index, query_vec: list[float], k: int, threshold: float | None = 0.0) -> Result:
    top = vector_topk(ix.chunk_vectors, query_vec, k, "chunk_id", threshold=threshold)
    return Result(_known(_ranked(top, [F.col("score").desc(), "chunk_id"]), ix.chunks))


def _select(hits: DataFrame, mapped: DataFrame, key: list[str], ix: Index, k: int) -> DataFrame:
    """Weighted selection over the hits' chunk lists, ids ascending within each."""
    src = hits.select(*key, F.col("rank").alias("source_rank")).join(mapped, key).select("source_rank", "chunk_id").distinct()
    return _known(fusion.weighted_rows(src, k, k), ix.chunks)


def local(ix: Index, low_vec: list[float], query: str, k: int) -> Result:
    top = vector_topk(ix.entity_vectors.withColumn("_id", F.concat_ws("\x1f", "namespace", "entity")), low_vec, k, "_id")
    hits = F.broadcast(_ranked(top, [F.col("score").desc(), "_id"]).select(F.element_at(F.split("_id", "\x1f"), 1).alias("namespace"), F.element_at(F.split("_id", "\x1f"), 2).alias("entity"), "rank", "score"))
    kg = _select(hits, ix.entity_chunks, ["namespace", "entity"], ix, k)
    ents = ix.nodes.join(hits, ["namespace", "entity"]).select("namespace", "entity", "entity_type", "description", "rank")
    return Result(_fuse(ix.rrf_k, kg, _bm25(ix, query, k)), ents, incident_edges(hits.select("namespace", "entity", "rank"), ix.edges))


def global_(ix: Index, high_vec: list[float], k: int) -> Result:
    top = vector_topk(ix.relation_vectors.withColumn("_id", F.concat_ws("\x1f", "namespace", "src", "tgt")), high_vec, k, "_id")
    part = lambda i: F.element_at(F.split("_id", "\x1f"), i)
    hits = F.broadcast(_ranked(top, [F.col("score").desc(), "_id"]).select(part(1).alias("namespace"), part(2).alias("src"), part(3).alias("tgt"), "rank"))
    kg = _select(hits, ix.relation_chunks, ["namespace", "src", "tgt"], ix, k)
    rels = ix.edges.join(hits, ["namespace", "src", "tgt"]).select("namespace", F.col("src").alias("source"), F.col("tgt").alias("target"), "rank", "weight", "keywords")
    seeds = hits.select("namespace", "rank", F.explode(F.array("src", "tgt")).alias("entity")).groupBy("namespace", "entity").agg(F.min("rank").alias("rank"))
    if ix.communities is not None:
        more = expand_communities(seeds, ix.communities).select("namespace", "entity").distinct().withColumn("rank", F.lit(2**30))
        seeds = seeds.unionByName(more)
    ents = ix.nodes.join(seeds, ["namespace", "entity"]).select("namespace", "entity", "entity_type", "description", "rank")
    return Result(kg, ents, rels)


def hybrid(ix: Index, low_vec: list[float], high_vec: list[float], query: str, k: int) -> Result:
    a, b = local(ix, low_vec, query, k), global_(ix, high_vec, k)
    tag = lambda d, i: d.withColumn("side", F.lit(i))
    ents = fusion.first_by(tag(a.entities, 0).unionByName(tag(b.entities, 1)), ["entity"], ["side", "rank", "namespace"])
    rels = tag(a.relations, 0).unionByName(tag(b.relations, 1)).withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    return Result(_fuse(ix.rrf_k, a.chunks, b.chunks), ents, fusion.first_by(rels, ["lo", "hi"], ["side", "rank", "namespace"]))


def mix(ix: Index, query_vec: list[float], low_vec: list[float], high_vec: list[float], query: str, k: int) -> Result:
    h = hybrid(ix, low_vec, high_vec, query, k)
    return Result(_fuse(ix.rrf_k, h.chunks, naive(ix, query_vec, k).chunks), h.entities, h.relations)


def search(ix: Index, mode: str, query: str, vectors: tuple[list[float], list[float], list[float]], k: int) -> Result:
    """One of the modes; ``vectors`` are those of the query, its low-level and its high-level keywords. Bypass retrieves like local."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if not 1 <= k <= 50:
        raise ValueError("top_k must be within 1 and 50")
    q, low, high = vectors
    if mode == "naive":
        return naive(ix, q, k)
    if mode == "global":
        return global_(ix, high, k)
    if mode == "hybrid":
        return hybrid(ix, low, high, query, k)
    if mode == "mix":
        return mix(ix, q, low, high, query, k)
    return local(ix, low, query, k)


def of_namespace(ix: Index, namespace: str) -> Index:
    """The tables of one of the namespaces."""
    kept = {f.name: t.where(F.col("namespace") == namespace) for f in fields(ix) if isinstance(t := getattr(ix, f.name), DataFrame)}
    return replace(ix, **kept)


def fuse_namespaces(results: dict[str, DataFrame], k: int = fusion.RRF_K) -> DataFrame:
    """(rank, chunk_id, score, namespace): each namespace's chunk list is one list of the fusion; the first namespace wins for equal ids."""
    u = None
    for i, (n, x) in enumerate(results.items()):
        one = x.select(F.lit(i).alias("list_id"), F.col("rank").cast("int").alias("rank"), "chunk_id", F.lit(n).alias("namespace"))
        u = one if u is None else u.unionByName(one)
    f = fusion.rrf(u, k, keep=["namespace"])
    return _ranked(f, [F.col("score").desc(), F.col("first.list_id"), F.col("first.rank"), "chunk_id"]).select("rank", "chunk_id", F.round("score", 9).alias("score"), "namespace")


def search_namespaces(indexes: dict[str, Index], mode: str, query: str, vectors: tuple[list[float], list[float], list[float]], k: int) -> Result:
    """``search`` in each namespace by itself. The chunk lists are fused; entities and relations follow in the order of the namespaces, equal names and pairs of ends once."""
    rs = {n: search(ix, mode, query, vectors, k) for n, ix in indexes.items()}
    ents = rels = None
    for i, r in enumerate(rs.values()):
        at = (F.col("rank") + F.lit(i * 2**31)).cast("long").alias("rank")
        if r.entities is not None:
            one = r.entities.select("namespace", "entity", "entity_type", "description", at)
            ents = one if ents is None else ents.unionByName(one)
        if r.relations is not None:
            one = r.relations.select("namespace", "source", "target", at, "weight", "keywords", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
            rels = one if rels is None else rels.unionByName(one)
    ents = ents if ents is None else fusion.first_by(ents, ["entity"], ["rank", "namespace"])
    rels = rels if rels is None else fusion.first_by(rels, ["lo", "hi"], ["rank", "namespace"]).drop("lo", "hi")
    return Result(fuse_namespaces({n: r.chunks for n, r in rs.items()}, next(iter(indexes.values())).rrf_k), ents, rels)
