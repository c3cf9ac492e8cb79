"""The engine: ingest files, keep the tables, retrieve and answer."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.config import Settings
from docmill.functions.text import citation_refs, strip, without_citations
from docmill.operators import chunking, context, enrich, graph, maintenance, retrieval
from docmill.operators.latest import upsert
from docmill.providers import Completer, Embedder, call_records, complete, embed
from docmill.sources.files import TableStore
from docmill.storage import materialize

TABLES = ["documents", "chunks", "enrichments", "chunk_vectors", "entity_vectors", "relation_vectors"]
EXTRACT = "Read the passage and reply with JSON: entities (name, type, description), relationships (source, target, keywords, description), keywords, summary.\n\n"
GLEAN = "The first extraction may have missed something. Read the text again and reply with JSON of the further entities and relationships only.\n\n"
CONTEXT = "For each of these consecutive chunks list contextual keywords that are not in it but help to understand it: one line of keywords with commas between them for each chunk, and a line of --- between the lines.\n\n"
SUMMARY = "Write one short description from these descriptions of one thing.\n\n"
KEYWORDS = 'Reply with JSON {"high_level": [...], "low_level": [...]} for the question: '
ANSWER = "Answer from the context only and cite chunks as [n].\n\n"


class NamespaceNotFound(KeyError):
    """No such namespace."""


def parse_keywords(reply: str, question: str) -> tuple[list[str], list[str]]:
    """High and low level keywords of a reply; the question itself where it has none."""
    s = re.sub(r"^```[^\n]*\n|\n?```\s*$", "", reply.strip())
    try:
        d = json.loads(s)
        high, low = ([str(x) for x in d.get(k, [])] for k in ("high_level", "low_level"))
    except (ValueError, AttributeError, TypeError):
        high, low = [], []
    return high, low or [question] if not (high or low) else low


class Engine:
    """Facade over the operators; every table has a namespace column."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings, embedder: Embedder, completer: Completer):
        self.spark, self.store, self.settings, self.embedder, self.completer = spark, TableStore(spark, root), settings, embedder, completer

    def ingest(self, parsed: DataFrame) -> None:
        """(doc_id, namespace, name, content_hash, text) rows, with sections and pages where the parser found some: unchanged documents are skipped, changed ones replace their chunks."""
        docs = parsed
        if self.store.exists("documents"):
            old = self.store.read("documents")
            act = maintenance.ingest_action(parsed.select("doc_id", "content_hash"), old.select("doc_id", "content_hash", "status"))
            docs = parsed.join(act.where("action in ('index', 'reindex')"), "doc_id", "left_semi")
        c = self.settings.chunking
        keep = [x for x in ("doc_id", "namespace", "name", "text", "sections", "pages") if x in docs.columns]
        new = chunking.chunk_documents(docs.select(*keep), c.max_chunk_tokens, c.overlap_tokens).dropDuplicates(["namespace", "chunk_id"])
        # written once: the model is asked once for a chunk, and all tables come from the same replies
        rows = materialize(self._enriched(new), "replies")
        touched = materialize(docs.select("namespace").distinct(), "touched")  # before the index that decides on it is replaced
        cols = ["namespace", "doc_id", "chunk_id", "sequence_index", "text", "section", "page", "token_count"]
        chunks = rows.select(*cols, F.to_json(enrich.merge_keywords(F.col("r.keywords"), F.col("extra"))).alias("keywords"), F.lit("[]").alias("expanded_keywords"), F.col("r.summary").alias("summary"), enrich.embedding_text(F.col("text"), F.col("extra")).alias("embedded"))
        enriched = rows.select("namespace", "doc_id", "chunk_id", "r.entities", "r.relationships")
        vec = embed(chunks.select("namespace", "doc_id", "chunk_id", "embedded"), "embedded", self.embedder).drop("embedded")
        for name, df in (("chunks", chunks.drop("embedded")), ("enrichments", enriched), ("chunk_vectors", vec)):
            self.store.replace(name, maintenance.purge(self.store.read(name), docs).unionByName(df) if self.store.exists(name) else df)
        meta = docs.select("doc_id", "namespace", "name", "content_hash", F.lit("indexed").alias("status"))
        self.store.replace("documents", upsert(self.store.read("documents"), meta, ["doc_id"]) if self.store.exists("documents") else meta)
        self.store.append("api_calls", call_records(rows, "llm", self.settings.model, "extract", "text", "reply").unionByName(call_records(rows, "embedding", self.settings.embedding_model, "embed_chunks", "text")))
        self._vectors(touched)

    def _contextual(self, new: DataFrame) -> DataFrame:
        """Chunks with their contextual keywords as ``extra``; one prompt for each batch of a document's chunks."""
        n = self.settings.ingestion.contextual_batch_size
        if not self.settings.ingestion.enable_contextual:
            return new.withColumn("extra", F.array().cast("array<string>"))
        rest = [c for c in new.columns if c not in ("namespace", "doc_id", "name", "sequence_index")]
        g = enrich.batch_windows(new, n).groupBy("namespace", "doc_id", "name", "batch").agg(F.array_sort(F.collect_list(F.struct("sequence_index", *rest))).alias("c"))
        prompt = F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]:\n"), x["text"])), "\n\n")
        g = complete(g.withColumn("prompt", F.concat(F.lit(CONTEXT), F.coalesce("name", F.lit("")), F.lit("\n\n"), prompt)), "prompt", self.completer)
        g = g.withColumn("parts", enrich.split_batch_reply(F.col("reply"), n)).select("namespace", "doc_id", "name", "parts", F.posexplode("c").alias("i", "x"))
        words = F.filter(F.transform(F.split(F.get("parts", F.col("i")), ","), strip), lambda k: k != "")
        return g.select("namespace", "doc_id", "name", "x.*", words.alias("extra"))

    def _enriched(self, new: DataFrame) -> DataFrame:
        """Chunks with ``extra`` and the parsed reply ``r``, gleaned once more where that is set."""
        rows = self._contextual(new)
        rows = complete(rows.withColumn("prompt", F.concat(F.lit(EXTRACT), enrich.embedding_text(F.col("text"), F.col("extra")))), "prompt", self.completer)
        rows = rows.withColumn("r", enrich.parse_reply(F.col("reply"))).drop("prompt")
        if not self.settings.ingestion.enable_gleaning:
            return rows
        found = F.concat(F.lit("Found before: "), F.size("r.entities").cast("string"), F.lit(" entities, "), F.size("r.relationships").cast("string"), F.lit(" relationships."))
        again = complete(rows.drop("reply").withColumn("prompt", F.concat(F.lit(GLEAN), F.col("text"), F.lit("\n\n"), found)), "prompt", self.completer)
        return again.withColumn("r", enrich.glean_reply(F.col("r"), enrich.parse_reply(F.col("reply")))).drop("prompt")

    def _vectors(self, namespaces: DataFrame) -> None:
        """Vectors of the graph anew, of the touched namespaces only."""
        touched = F.broadcast(namespaces)
        nodes, edges = (x.join(touched, "namespace", "left_semi") for x in self._graph())
        ev = embed(nodes.select("namespace", "entity", F.concat_ws("\n", "entity", "description").alias("t")), "t", self.embedder).drop("t")
        rv = embed(edges.select("namespace", "src", "tgt", F.concat_ws("\t", "keywords", "src", "tgt", "description").alias("t")), "t", self.embedder).drop("t")
        names = [r.namespace for r in touched.collect()]
        self.store.replace_namespaces("entity_vectors", ev, names)
        self.store.replace_namespaces("relation_vectors", rv, names)

    def _occurrences(self) -> tuple[DataFrame, DataFrame]:
        e = self.store.read("enrichments")
        ents = e.select("namespace", "chunk_id", F.posexplode("entities").alias("p", "x")).select(F.xxhash64("chunk_id", "p").alias("extraction_id"), "namespace", "chunk_id", "x.name", "x.type", "x.description")
        rels = e.select("namespace", "chunk_id", F.posexplode("relationships").alias("p", "x")).select(F.xxhash64("chunk_id", "p").alias("relation_id"), "namespace", "chunk_id", "x.source", "x.target", "x.keywords", "x.description")
        return graph.entity_occurrences(ents), graph.relation_occurrences(rels)

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        ents, rels = self._occurrences()
        return self._merged(ents, rels)

    def _merged(self, ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges; those with many descriptions get the model's summary of them where that is set."""
        nodes, edges = graph.merge_entities(ents), graph.merge_relations(rels)
        if not self.settings.ingestion.enable_llm_summary:
            return nodes, edges
        out = []
        for merged, occ, key in ((nodes, ents, ["namespace", "entity"]), (edges, rels, ["namespace", "src", "tgt"])):
            many = graph.many_descriptions(occ, key, self.settings.ingestion.min_descriptions)
            prompt = F.concat(F.lit(SUMMARY), F.concat_ws(" - ", *key[1:]), F.lit("\n"), F.array_join("descriptions", "\n"))
            out.append(graph.with_summaries(merged, materialize(complete(many.withColumn("prompt", prompt), "prompt", self.completer), "summaries"), key))
        return out[0], out[1]

    def index(self, namespaces: list[str] | None = None) -> retrieval.Index:
        known = {r.namespace for r in self.store.read("documents").select("namespace").distinct().collect()}
        if namespaces and (bad := set(namespaces) - known):
            raise NamespaceNotFound(sorted(bad)[0])
        keep = lambda d: d if not namespaces else d.where(F.col("namespace").isin(*namespaces))
        ents, rels = (keep(x) for x in self._occurrences())
        nodes, edges = self._merged(ents, rels)
        comm = graph.communities(edges) if self.settings.retrieval.enable_community_search else None
        return retrieval.Index(keep(self.store.read("chunks")), nodes, edges, graph.entity_chunks(ents), graph.relation_chunks(rels), keep(self.store.read("chunk_vectors")), keep(self.store.read("entity_vectors")), keep(self.store.read("relation_vectors")), comm, self.settings.retrieval.rrf_k)

    def retrieve(self, question: str, mode: str | None = None, top_k: int | None = None, namespaces: list[str] | None = None) -> retrieval.Result:
        high, low = parse_keywords(self.completer.complete(KEYWORDS + question), question)
        v = self.embedder.embed_batch([question, " ".join(low) or question, " ".join(high) or question])
        names = list(dict.fromkeys(namespaces)) if namespaces else sorted(r.namespace for r in self.store.read("documents").select("namespace").distinct().collect())
        indexes = {n: self.index([n]) for n in names} or {"": self.index()}
        return retrieval.search_namespaces(indexes, mode or self.settings.retrieval.default_mode, question, tuple(v), top_k or self.settings.retrieval.top_k)

    def query(self, question: str, mode: str | None = None, top_k: int | None = None, namespaces: list[str] | None = None) -> dict:
        """Answer with sources; bypass asks the model alone."""
        if mode == "bypass":
            return {"answer": self.completer.complete(question), "sources": [], "chunks": []}
        r = self.retrieve(question, mode, top_k, namespaces)
        k = top_k or self.settings.retrieval.top_k
        rows = r.chunks.orderBy("rank").join(self.store.read("chunks").select("chunk_id", "namespace", F.col("doc_id").alias("source"), "text"), ["namespace", "chunk_id"])
        empty = self.spark.createDataFrame([], "entity string, type string, description string, rank int")
        ents = empty if r.entities is None else r.entities.select("entity", F.col("entity_type").alias("type"), "description", "rank")
        rels = self.spark.createDataFrame([], "source string, target string, description string, rank int") if r.relations is None else r.relations.select("source", "target", F.col("keywords").alias("description"), "rank")
        text = context.build_context(ents, rels, rows, self.settings.retrieval.max_entity_tokens, self.settings.retrieval.max_relation_tokens, self.settings.retrieval.max_total_tokens, len(ANSWER))
        answer = self.completer.complete(f"{ANSWER}{text}\n\n{question}")
        one = self.spark.createDataFrame([("a", answer)], "answer_id string, answer string")
        refs = rows.select(F.lit("a").alias("answer_id"), (F.col("rank") + 1).cast("int").alias("ref"), F.col("source").alias("doc_id"), "namespace")
        sources = [(s.doc_id, s.namespace) for s in context.cited_sources(one, refs).orderBy("first_ref").collect()]
        shown = answer if self.settings.show_references else one.select(strip(without_citations(F.col("answer")))).first()[0]
        return {"answer": shown, "sources": sources, "chunks": [x.chunk_id for x in r.chunks.orderBy("rank").limit(k).collect()], "refs": one.select(citation_refs(F.col("answer"))).first()[0]}

    def delete_document(self, doc_id: str) -> None:
        ids = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        touched = materialize(self.store.read("documents").join(F.broadcast(ids), "doc_id", "left_semi").select("namespace").distinct(), "touched")
        for n in ("chunks", "enrichments", "chunk_vectors", "documents"):
            self.store.replace(n, maintenance.purge(self.store.read(n), ids))
        self._vectors(touched)

    def drop_namespace(self, namespace: str) -> None:
        self.store.drop_namespace(namespace, TABLES)
