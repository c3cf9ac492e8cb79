"""The project's tables as the operators take them, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import graph
from docmill.operators.latest import last_per_key
from docmill.operators.retrieval import Index
from docmill.storage import table


#: What tells which of several rows of one document or chunk is the latest.
DOC_ORDER = ["synced_at", "drive_modified_time", "content_hash", "status", "name", "file_size", "url", "namespace"]
CHUNK_ORDER = ["ingested_at", "sequence_index", "doc_id", "token_count", "page", "section", "summary", "keywords", "category", "lang", "namespace"]


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def docs(self) -> DataFrame:
        return last_per_key(self.raw("drive_documents"), ["doc_id"], DOC_ORDER)

    @property
    def chunks(self) -> DataFrame:
        return last_per_key(self.raw("chunks"), ["chunk_id"], CHUNK_ORDER)

    def chunks_among(self, ids: DataFrame) -> DataFrame:
        """The latest rows of some chunk ids; the other rows never reach the aggregate."""
        return last_per_key(self.raw("chunks").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"), ["chunk_id"], CHUNK_ORDER)

    def docs_among(self, ids: DataFrame) -> DataFrame:
        return last_per_key(self.raw("drive_documents").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"], DOC_ORDER)

    @property
    def ents(self) -> DataFrame:
        return graph.entity_occurrences(self.raw("entity_extractions"))

    @property
    def rels(self) -> DataFrame:
        return graph.relation_occurrences(self.raw("relation_extractions"))

    @property
    def nodes(self) -> DataFrame:
        return graph.merge_entities(self.ents)

    @property
    def edges(self) -> DataFrame:
        return graph.merge_relations(self.rels)

    def vectors(self, df: DataFrame, *key: str) -> DataFrame:
        """A synthetic pairing: the vector whose number is a hash of the key."""
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 6), 16, 10).cast("long") % self.raw("embeddings").count()
        return df.select(*key).distinct().withColumn("vec_id", h).join(self.raw("embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")

    def probe(self, vec_id: int) -> list[float]:
        return self.raw("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]

    def index(self) -> Index:
        ents, rels = self.ents, self.rels
        ec, rc = graph.entity_chunks(ents), graph.relation_chunks(rels)
        members = ec.select("namespace", "entity").distinct().select("namespace", F.substring(F.md5("entity"), 1, 2).alias("community_id"), "entity")
        return Index(self.chunks, self.nodes, self.edges, ec, rc, self.vectors(self.raw("chunks"), "chunk_id"), self.vectors(ec, "namespace", "entity"), self.vectors(rc, "namespace", "src", "tgt"), members)


def _last(t: str, key: str, order: list[str]) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in order)}) AS rn FROM {t}) WHERE rn = 1"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_key = lambda c: "lower(" + _STRIP.format(c) + ")"
_DESC = """SELECT {k}, CASE WHEN count(*) > 3 THEN string_agg(description, ' | ' ORDER BY r) FILTER (WHERE r <= 3) || ' (+' || (count(*) - 3) || ' more)' ELSE string_agg(description, ' | ' ORDER BY r) END AS description
  FROM (SELECT {k}, description, row_number() OVER (PARTITION BY {k} ORDER BY p, description) AS r FROM (SELECT {k}, description, min(pos) AS p FROM {t} WHERE description <> '' GROUP BY ALL)) GROUP BY {k}"""
CTE = {
    "docs": (_last("drive_documents", "doc_id", DOC_ORDER), []),
    "ch": (_last("chunks", "chunk_id", CHUNK_ORDER), []),
    "ents": (f"SELECT DISTINCT extraction_id AS pos, namespace, chunk_id, {_key('name')} AS entity, coalesce(nullif({_key('type')}, ''), 'other') AS type, coalesce(description, '') AS description FROM entity_extractions WHERE {_key('name')} <> ''", []),
    "rels": (f"SELECT DISTINCT relation_id AS pos, namespace, chunk_id, least(a, b) AS src, greatest(a, b) AS tgt, keywords, description FROM (SELECT *, {_key('source')} AS a, {_key('target')} AS b, coalesce(keywords, '') AS kw, coalesce(description, '') AS de FROM relation_extractions) WHERE a <> '' AND b <> '' AND a <> b".replace("keywords, description FROM (", "kw AS keywords, de AS description FROM ("), []),
    "edesc": (_DESC.format(k="namespace, entity", t="ents"), ["ents"]),
    "rdesc": (_DESC.format(k="namespace, src, tgt", t="rels"), ["rels"]),
    "nodes": ("SELECT n.namespace, n.entity, n.entity_type, n.mentions, coalesce(d.description, '') AS description FROM (SELECT namespace, entity, arg_max(type, (c, -p)) AS entity_type, sum(c)::BIGINT AS mentions FROM (SELECT namespace, entity, type, count(*) AS c, min(pos) AS p FROM ents GROUP BY ALL) GROUP BY ALL) n LEFT JOIN edesc d USING (namespace, entity)", ["ents", "edesc"]),
    "edges": (f"SELECT e.namespace, e.src, e.tgt, e.weight, coalesce(k.keywords, '') AS keywords, coalesce(d.description, '') AS description FROM (SELECT namespace, src, tgt, count(*)::DOUBLE AS weight FROM rels GROUP BY ALL) e LEFT JOIN (SELECT namespace, src, tgt, string_agg(k, ', ' ORDER BY k) AS keywords FROM (SELECT DISTINCT namespace, src, tgt, {_STRIP.format('k')} AS k FROM (SELECT namespace, src, tgt, unnest(string_split(keywords, ',')) AS k FROM rels)) WHERE k <> '' GROUP BY ALL) k USING (namespace, src, tgt) LEFT JOIN rdesc d USING (namespace, src, tgt)", ["rels", "rdesc"]),
    "ec": ("SELECT DISTINCT namespace, entity, chunk_id FROM ents", ["ents"]),
    "rc": ("SELECT DISTINCT namespace, src, tgt, chunk_id FROM rels", ["rels"]),
    "members": ("SELECT DISTINCT namespace, substr(md5(entity), 1, 2) AS community_id, entity FROM ec", ["ec"]),
}
VEC = "CAST('0x' || substr(md5({}), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings)"


def sql(body: str, *names: str) -> str:
    """``body`` with the views it needs."""
    need: list[str] = []

    def add(n: str) -> None:
        for d in CTE[n][1]:
            add(d)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n][0]})" for n in need) + " " if need else "") + body
