"""The knowledge graph: merging extracted entities and relations, traversal, communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import entity_key, strip


def entity_occurrences(ext: DataFrame) -> DataFrame:
    """(namespace, entity, type, description, chunk_id, pos) of every extraction with a name, repeated rows once."""
    rows = ext.select(F.col("extraction_id").alias("pos"), "namespace", "chunk_id", entity_key(F.col("name")).alias("entity"), F.coalesce(F.nullif(F.lower(strip(F.col("type"))), F.lit("")), F.lit("other")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    return rows.where("entity <> ''").distinct()


def relation_occurrences(ext: DataFrame) -> DataFrame:
    """(namespace, src, tgt, keywords, description, chunk_id, pos), ends in order; blank ends and loops are dropped."""
    a, b = entity_key(F.col("source")), entity_key(F.col("target"))
    rows = ext.select(F.col("relation_id").alias("pos"), "namespace", "chunk_id", a.alias("a"), b.alias("b"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("description", F.lit("")).alias("description"))
    return rows.where("a <> '' and b <> '' and a <> b").select("pos", "namespace", "chunk_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"), "keywords", "description").distinct()


def merge_descriptions(ds: Column, keep: int = 3) -> Column:
    """Different non-empty descriptions in order: all of up to three, else the first three and how many more."""
    d = F.array_distinct(F.filter(ds, lambda x: x != ""))
    few = F.array_join(F.slice(d, 1, keep), " | ")
    return F.when(F.size(d) <= keep, few).otherwise(F.concat(few, F.lit(" (+"), (F.size(d) - keep).cast("string"), F.lit(" more)")))


def _first_descriptions(occ: DataFrame, key: list[str]) -> DataFrame:
    """Merged description of each key. Equal texts are merged before the shuffle, and only a hot key's *different* texts meet; beyond the first three they are only counted."""
    first = occ.where("description <> ''").groupBy(*key, "description").agg(F.min("pos").alias("p"))
    # the three earliest are kept by a bounded aggregate: minimum, then the minima of what is left
    one = first.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("p", "description")).alias("d1"))
    rest = first.join(one.select(*key, "d1"), key).where(F.struct("p", "description") > F.col("d1"))
    two = rest.groupBy(*key).agg(F.min(F.struct("p", "description")).alias("d2"))
    rest = rest.join(two, key).where(F.struct("p", "description") > F.col("d2"))
    three = rest.groupBy(*key).agg(F.min(F.struct("p", "description")).alias("d3"))
    out = one.join(two, key, "left").join(three, key, "left")
    head = F.concat_ws(" | ", F.col("d1.description"), F.col("d2.description"), F.col("d3.description"))
    return out.select(*key, F.when(F.col("n") > 3, F.concat(head, F.lit(" (+"), (F.col("n") - 3).cast("string"), F.lit(" more)"))).otherwise(head).alias("description"))


def many_descriptions(occ: DataFrame, key: list[str], least: int, most: int = 40) -> DataFrame:
    """(key…, n, descriptions) of the keys with at least ``least`` different descriptions: the first ``most`` in order, for a summary, and how many there are."""
    first = occ.where("description <> ''").groupBy(*key, "description").agg(F.min("pos").alias("p"))
    n = first.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    some = first.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("p", "description"))).where(F.col("r") <= most)
    g = some.join(n, key).groupBy(*key, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "description"))), lambda x: x["description"]).alias("descriptions"))
    return g.select(*key, "n", "descriptions")


def with_summaries(merged: DataFrame, summaries: DataFrame, key: list[str]) -> DataFrame:
    """Nodes or edges whose description is the summary (key…, reply) where there is one that is not blank."""
    s = summaries.select(*key, F.nullif(strip(F.col("reply")), F.lit("")).alias("_s"))
    return merged.join(s, key, "left").withColumn("description", F.coalesce("_s", "description")).drop("_s").select(*merged.columns)


def merge_entities(occ: DataFrame) -> DataFrame:
    """Nodes (namespace, entity, entity_type, description, mentions): the most common type, the first seen on a tie."""
    key = ["namespace", "entity"]
    kinds = occ.groupBy(*key, "type").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    node = kinds.groupBy(*key).agg(F.max_by("type", F.struct("n", -F.col("p"))).alias("entity_type"), F.sum("n").alias("mentions"))
    return node.join(_first_descriptions(occ, key), key, "left").withColumn("description", F.coalesce("description", F.lit("")))


def merge_relations(occ: DataFrame) -> DataFrame:
    """Edges (namespace, src, tgt, weight, keywords, description)."""
    key = ["namespace", "src", "tgt"]
    edge = occ.groupBy(*key).agg(F.count("*").cast("double").alias("weight"))
    words = occ.select(*key, F.explode(F.split("keywords", ",")).alias("k")).withColumn("k", strip(F.col("k"))).where("k <> ''").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("k")), ", ").alias("keywords"))
    out = edge.join(words, key, "left").join(_first_descriptions(occ, key), key, "left")
    return out.select(*key, "weight", F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("description", F.lit("")).alias("description"))


def entity_chunks(occ: DataFrame) -> DataFrame:
    return occ.select("namespace", "entity", "chunk_id").distinct()


def relation_chunks(occ: DataFrame) -> DataFrame:
    return occ.select("namespace", "src", "tgt", "chunk_id").distinct()


def incident_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch a hit (namespace, entity, rank), seen from the hit; an edge between two hits is given once, from the better one. Two equi-joins, no OR."""
    a = edges.join(hits, (edges.src == hits.entity) & (edges.namespace == hits.namespace)).select(edges.namespace, edges.src, edges.tgt, F.col("src").alias("source"), F.col("tgt").alias("target"), "rank", "weight", "keywords", edges.description)
    b = edges.join(hits, (edges.tgt == hits.entity) & (edges.namespace == hits.namespace)).select(edges.namespace, edges.src, edges.tgt, F.col("tgt").alias("source"), F.col("src").alias("target"), "rank", "weight", "keywords", edges.description)
    u = a.unionByName(b)
    return u.groupBy("namespace", "src", "tgt").agg(F.min_by(F.struct("source", "target", "rank", "weight", "keywords"), F.struct("rank", "source")).alias("v")).select("namespace", "v.*")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("namespace", F.explode(F.array("src", "tgt")).alias("entity"))
    return ends.groupBy("namespace", "entity").agg(F.count("*").alias("degree"))


def expand_communities(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """Members of the communities that hold a seed, without the seeds."""
    hit = members.join(seeds.select("namespace", "entity").distinct(), ["namespace", "entity"], "left_semi").select("namespace", "community_id").distinct()
    return members.join(hit, ["namespace", "community_id"], "left_semi").join(seeds.select("namespace", "entity"), ["namespace", "entity"], "left_anti")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the nodes and their edges."""
    g = gone.select("namespace", "entity").distinct()
    kept = nodes.join(g, ["namespace", "entity"], "left_anti")
    for end in ("src", "tgt"):
        edges = edges.join(g.withColumnRenamed("entity", end), ["namespace", end], "left_anti")
    return kept, edges


def louvain(pairs: list[tuple[str, str, float]]) -> dict[str, int]:
    """Two-phase modularity communities (Blondel et al., 2008); nodes in order of their names, so the result is always the same."""
    if not pairs:
        return {}
    a, b, w = zip(*pairs)
    codes, names = pd.factorize(np.array(a + b, dtype=object), sort=True)
    return dict(zip(names.tolist(), louvain_codes(codes[: len(a)], codes[len(a) :], np.array(w, dtype=float), len(names)).tolist()))


def louvain_codes(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Community of each of the nodes 0 to n-1, in arrays of 24 bytes an edge end; rounds go on until no node moves and passes until none has moved.

    Gains are times the doubled weight. With whole weights they are whole numbers,
    compared exactly; every move raises the modularity, so the rounds end.
    """
    whole = bool((w == np.floor(w)).all())
    part = np.arange(n)
    while True:
        lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        pair, at = np.unique(lo * n + hi, return_inverse=True)
        w = np.bincount(at, weights=w, minlength=len(pair))
        a, b = pair // n, pair % n
        k = np.bincount(a, weights=w, minlength=n) + np.bincount(b, weights=w, minlength=n)
        two = a != b
        ends, others, ws = np.concatenate([a[two], b[two]]), np.concatenate([b[two], a[two]]), np.concatenate([w[two], w[two]])
        order = np.argsort(ends, kind="stable")
        others, ws = others[order], ws[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()
        del ends, order, pair, at
        if whole:
            k, ws = k.astype(np.int64), ws.astype(np.int64)
        k = k.tolist()
        tot, m2, comm, moved = k[:], sum(k), list(range(n)), False
        least = 0 if whole else 1e-12 * m2
        again = True
        while again:
            again = False
            for i in range(n):
                links: dict[int, float] = {}
                for j, x in zip(others[start[i] : start[i + 1]].tolist(), ws[start[i] : start[i + 1]].tolist()):
                    c = comm[j]
                    links[c] = links.get(c, 0) + x
                old, ki = comm[i], k[i]
                tot[old] -= ki
                best, gain = old, links.get(old, 0) * m2 - tot[old] * ki
                for c in sorted(links):
                    g = links[c] * m2 - tot[c] * ki
                    if g > gain + least:
                        best, gain = c, g
                tot[best] += ki
                if best != old:
                    comm[i], again, moved = best, True, True
        ids, comm = np.unique(np.array(comm, dtype=np.int64), return_inverse=True)
        part = comm[part]
        if not moved:
            return part
        a, b, n = comm[a], comm[b], len(ids)


def communities(edges: DataFrame) -> DataFrame:
    """(namespace, community_id, entity) by Louvain in one task per namespace, whatever its size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        space, m = pdf.namespace.iloc[0], len(pdf)
        codes, names = pd.factorize(pd.concat([pdf.pop("src"), pdf.pop("tgt")], ignore_index=True), sort=True)
        got = louvain_codes(codes[:m], codes[m:], pdf.weight.to_numpy(), len(names))
        return pd.DataFrame({"namespace": space, "community_id": got, "entity": names, "method": "louvain"})

    return edges.select("namespace", "src", "tgt", "weight").groupBy("namespace").applyInPandas(one, "namespace string, community_id long, entity string, method string")
