"""Queries of the core's operators over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import bm25, chunking, context, enrich, fusion, graph, inspect, maintenance, retrieval, vector
from docmill.sources import files
from docmill.plans.views import _key, _STRIP, VEC, Views, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: A chunk and an entity of every scale, found by their smallest ids.
TOP_K = 10


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            SQL[name] = oracle
        return f

    return add


# --- sources and listings


@query("op_s2_oversized", "SELECT doc_id, max(file_size) AS file_size FROM drive_documents WHERE file_size > 524288 GROUP BY doc_id")
def _(v):
    return inspect.oversized(v.raw("drive_documents"), 524288)


@query("op_s3_file_metadata", sql("SELECT doc_id, drive_file_id, drive_modified_time, file_size, url FROM docs WHERE drive_file_id = (SELECT min(drive_file_id) FROM drive_documents)", "docs"))
def _(v):
    one = v.raw("drive_documents").agg(F.min("drive_file_id").alias("drive_file_id"))
    return v.docs.join(F.broadcast(one), "drive_file_id").select("doc_id", "drive_file_id", "drive_modified_time", "file_size", "url")


_MD = "'# ' || source || chr(10) || text || chr(10) || '## ' || coalesce(lang, 'x') || chr(10) || text"


@query("op_s9_markdown_headings", f"""SELECT doc_id, count(*) AS n_headings FROM (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS s FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE regexp_matches(s, '^#{{1,6}}\\s+.+$') GROUP BY doc_id""")
def _(v):
    d = v.raw("documents").where("text is not null and source is not null").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## "), F.coalesce("lang", F.lit("x")), F.lit("\n"), "text").alias("text"))
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.where(F.col("s").rlike(r"^#{1,6}\s+.+$")).groupBy("doc_id").agg(F.count("*").alias("n_headings"))


_OUTER = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_LINES = "(SELECT doc_id, unnest(range(0, len(x))) AS line, len(x) AS n, unnest(x) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))"
_HEAD = r"'^(#{1,6})\s+(.+)$'"
_SECTIONS = f"""SELECT doc_id, sec AS section, level, {_OUTER.format('heading')} AS heading, body FROM (SELECT doc_id, sec, max(level)::INT AS level, max(heading) AS heading, {_OUTER.format("coalesce(string_agg(CASE WHEN level = 0 THEN s END, chr(10) ORDER BY line), '')")} AS body
    FROM (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS sec FROM (SELECT *, length(regexp_extract(s, {_HEAD}, 1)) AS level, CASE WHEN regexp_matches(s, {_HEAD}) THEN regexp_extract(s, {_HEAD}, 2) END AS heading FROM {_LINES})) WHERE sec > 0 GROUP BY doc_id, sec) WHERE body <> ''"""
_PLAIN = f"""WITH t AS (SELECT *, coalesce(lag(t) OVER w, '') AS prev, coalesce(lead(t) OVER w, '') AS next, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS k FROM (SELECT doc_id, line, {_OUTER.format('s')} AS t FROM {_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    h AS (SELECT doc_id, line::INT AS line, t AS heading FROM t WHERE t <> '' AND length(t) <= 120 AND NOT regexp_matches(t, '[.!?;,:''"]$') AND k <= 15 AND (prev = '' AND next = '' OR k <= 10 AND length(next) > 1.5 * length(t)))
    SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM h GROUP BY 1 HAVING count(*) >= 2)"""
_PATHS = f"""SELECT doc_id, unnest(out).section AS section, unnest(out).path AS path FROM (SELECT doc_id, list_reduce(list_prepend({{'stack': []::VARCHAR[], 'out': []::STRUCT(section BIGINT, path VARCHAR)[], 'level': 0, 'heading': '', 'section': 0::BIGINT}}, list({{'stack': []::VARCHAR[], 'out': []::STRUCT(section BIGINT, path VARCHAR)[], 'level': level, 'heading': heading, 'section': section}} ORDER BY section)),
    lambda a, x: {{'stack': list_append(a.stack[1:x.level - 1], x.heading), 'out': list_append(a.out, {{'section': x.section, 'path': array_to_string(list_append(a.stack[1:x.level - 1], x.heading), ' > ')}}), 'level': 0, 'heading': '', 'section': 0::BIGINT}}).out AS out FROM ({_SECTIONS}) GROUP BY doc_id)"""


@query("op_s9_markdown_sections", _SECTIONS)
def _(v):
    return chunking.markdown_sections(v.raw("documents").select("doc_id", "text"))


@query("op_s10_plaintext_sections", _PLAIN)
def _(v):
    return chunking.plaintext_sections(v.raw("documents").select("doc_id", "text"))


@query("op_w5_heading_paths", _PATHS)
def _(v):
    return chunking.heading_paths(chunking.markdown_sections(v.raw("documents").select("doc_id", "text")))


@query("op_s11_mime_dispatch", "SELECT doc_id, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'md' THEN 'text' WHEN 'txt' THEN 'text' WHEN 'markdown' THEN 'text' WHEN '' THEN 'text' ELSE 'unsupported' END AS parser FROM (SELECT DISTINCT doc_id, coalesce(name, '') AS name FROM drive_documents)")
def _(v):
    d = v.raw("drive_documents").select("doc_id", F.coalesce("name", F.lit("")).alias("name")).distinct()
    return d.select("doc_id", files.parser_of(F.col("name")).alias("parser"))


# --- lookups and navigation


@query("op_p1_document", sql("SELECT doc_id, name, status, content_hash FROM docs WHERE doc_id = (SELECT min(doc_id) FROM drive_documents)", "docs"))
def _(v):
    one = F.broadcast(v.raw("drive_documents").agg(F.min("doc_id").alias("doc_id")))
    return v.docs_among(one).select("doc_id", "name", "status", "content_hash")


@query("op_p2_documents", sql("SELECT d.namespace, d.doc_id, d.name, d.status, coalesce(c.n, 0) AS n_chunks FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1) c USING (doc_id)", "docs", "ch"))
def _(v):
    return inspect.list_documents(v.docs, v.chunks).select("namespace", "doc_id", "name", "status", "n_chunks")


@query("op_p3_chunk", sql("SELECT chunk_id, doc_id, text, page FROM ch WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)", "ch"))
def _(v):
    one = F.broadcast(v.raw("chunks").agg(F.min("chunk_id").alias("chunk_id")))
    return v.chunks_among(one).select("chunk_id", "doc_id", "text", "page")


@query("op_p4_chunks_by_doc", sql("SELECT chunk_id, sequence_index, text FROM ch WHERE doc_id = (SELECT min(doc_id) FROM chunks)", "ch"))
def _(v):
    one = F.broadcast(v.raw("chunks").agg(F.min("doc_id").alias("doc_id")))
    # an id that any row gives to the document; whether its latest row does is seen after that
    return v.chunks_among(v.raw("chunks").join(one, "doc_id")).join(one, "doc_id").select("chunk_id", "sequence_index", "text").orderBy("sequence_index", "chunk_id")


@query("op_p5_chunk_detail", sql("SELECT c.chunk_id, c.doc_id, c.sequence_index, t.total, c.sequence_index > 0 AS has_previous, c.sequence_index < t.total - 1 AS has_next, coalesce(json_array_length(CASE WHEN json_valid(c.keywords) THEN c.keywords END), 0)::INT AS n_keywords, coalesce(d.name, c.doc_id) AS document FROM ch c JOIN (SELECT doc_id, count(*) AS total FROM ch GROUP BY 1) t USING (doc_id) LEFT JOIN docs d ON d.doc_id = c.doc_id", "ch", "docs"))
def _(v):
    return inspect.chunk_detail(v.chunks, v.docs)


@query("op_p7_nodes_by_type", sql("SELECT namespace, entity, entity_type FROM nodes WHERE entity_type = 'person' ORDER BY namespace, entity LIMIT 100", "nodes"))
def _(v):
    return v.nodes.where("entity_type = 'person'").orderBy("namespace", "entity").limit(100).select("namespace", "entity", "entity_type")


@query("op_p8_entities", sql("SELECT n.namespace, n.entity, n.entity_type, coalesce(c.n, 0) AS chunk_count FROM (SELECT * FROM nodes ORDER BY namespace, entity LIMIT 50) n LEFT JOIN (SELECT namespace, entity, count(*) AS n FROM ec GROUP BY ALL) c USING (namespace, entity)", "nodes", "ec"))
def _(v):
    return inspect.list_entities(v.nodes, graph.entity_chunks(v.ents))


@query("op_p9_relations", sql("SELECT namespace, src AS source, tgt AS target, keywords AS relation, weight FROM edges ORDER BY namespace, src, tgt LIMIT 100", "edges"))
def _(v):
    return inspect.list_relations(v.edges)


@query("op_p9_relations_of_entity", sql("SELECT namespace, 'brannock fieldworks' AS source, CASE WHEN src = 'brannock fieldworks' THEN tgt ELSE src END AS target, keywords AS relation, weight FROM edges WHERE src = 'brannock fieldworks' OR tgt = 'brannock fieldworks'", "edges"))
def _(v):
    return inspect.list_relations(v.edges, "brannock fieldworks")


@query("op_p10_api_calls_page", "SELECT id, call_type, model, created_at, namespace FROM (SELECT * FROM api_calls WHERE call_type = 'llm' ORDER BY created_at DESC, id LIMIT 50 OFFSET 25)")
def _(v):
    return inspect.api_calls_page(v.raw("api_calls"), "llm", None, 50, 25).select("id", "call_type", "model", "created_at", "namespace")


@query("op_p12_valid_relations", f"SELECT relation_id, source, target FROM relation_extractions WHERE {_STRIP.format("coalesce(source, '')")} <> '' AND {_STRIP.format("coalesce(target, '')")} <> '' AND lower({_STRIP.format('source')}) <> lower({_STRIP.format('target')})")
def _(v):
    return enrich.valid_relations(v.raw("relation_extractions")).select("relation_id", "source", "target")


# --- joins


#: The query set of the navigation operators: every fiftieth chunk of each document, against all chunks.
_SEEDS = "(SELECT chunk_id, doc_id, sequence_index FROM ch WHERE sequence_index % 50 = 0)"


@query("op_j11_chunk_context", sql(f"SELECT t.chunk_id AS target, c.chunk_id, c.sequence_index, c.chunk_id = t.chunk_id AS is_target, t.sequence_index - 2 > 0 AS has_more_before, t.sequence_index + 2 < n.total - 1 AS has_more_after FROM {_SEEDS} t JOIN ch c ON c.doc_id = t.doc_id AND c.sequence_index BETWEEN greatest(0, t.sequence_index - 2) AND t.sequence_index + 2 JOIN (SELECT doc_id, count(*) AS total FROM ch GROUP BY 1) n ON n.doc_id = t.doc_id", "ch"))
def _(v):
    return inspect.chunk_context(v.chunks, v.chunks.where("sequence_index % 50 = 0"))


@query("op_j12_siblings", sql(f"SELECT t.chunk_id AS target, c.chunk_id, c.sequence_index FROM {_SEEDS} t JOIN ch c USING (doc_id)", "ch"))
def _(v):
    return inspect.siblings(v.chunks, v.chunks.where("sequence_index % 50 = 0"))


_HITS = "(SELECT namespace, entity, row_number() OVER (ORDER BY mentions DESC, namespace, entity) - 1 AS rank FROM nodes ORDER BY rank LIMIT 10)"


def _hits(v: Views) -> DataFrame:
    top = v.nodes.orderBy(F.col("mentions").desc(), "namespace", "entity").limit(10)
    return retrieval._ranked(top, [F.col("mentions").desc(), "namespace", "entity"]).select("namespace", "entity", F.col("rank").cast("long").alias("rank"))


@query("op_j2_hit_nodes", sql(f"SELECT h.rank, n.namespace, n.entity, n.entity_type, n.description FROM {_HITS} h JOIN nodes n USING (namespace, entity)", "nodes"))
def _(v):
    return v.nodes.join(F.broadcast(_hits(v)), ["namespace", "entity"]).select("rank", "namespace", "entity", "entity_type", "description")


@query("op_j3_incident_edges", sql(f"SELECT namespace, source, target, rank, weight, keywords FROM (SELECT *, row_number() OVER (PARTITION BY namespace, src, tgt ORDER BY rank, source) AS rn FROM (SELECT e.*, e.src AS source, e.tgt AS target, h.rank FROM edges e JOIN {_HITS} h ON h.entity = e.src AND h.namespace = e.namespace UNION ALL SELECT e.*, e.tgt, e.src, h.rank FROM edges e JOIN {_HITS} h ON h.entity = e.tgt AND h.namespace = e.namespace)) WHERE rn = 1", "nodes", "edges"))
def _(v):
    return graph.incident_edges(F.broadcast(_hits(v)), v.edges)


@query("op_j4_entity_chunks", sql(f"SELECT namespace, entity, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM ec SEMI JOIN {_HITS} USING (namespace, entity) GROUP BY ALL", "nodes", "ec"))
def _(v):
    m = graph.entity_chunks(v.ents).join(F.broadcast(_hits(v)), ["namespace", "entity"], "left_semi")
    return m.groupBy("namespace", "entity").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunk_ids"))


_EHITS = "(SELECT namespace, src, tgt, row_number() OVER (ORDER BY weight DESC, namespace, src, tgt) - 1 AS rank FROM edges ORDER BY rank LIMIT 10)"


def _edge_hits(v: Views) -> DataFrame:
    top = v.edges.orderBy(F.col("weight").desc(), "namespace", "src", "tgt").limit(10)
    return retrieval._ranked(top, [F.col("weight").desc(), "namespace", "src", "tgt"]).select("namespace", "src", "tgt", F.col("rank").cast("long").alias("rank"))


@query("op_j5_hit_edges", sql(f"SELECT h.rank, e.* FROM {_EHITS} h JOIN edges e USING (namespace, src, tgt)", "edges"))
def _(v):
    return v.edges.join(F.broadcast(_edge_hits(v)), ["namespace", "src", "tgt"])


@query("op_j6_relation_chunks", sql(f"SELECT namespace, src, tgt, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM rc SEMI JOIN {_EHITS} USING (namespace, src, tgt) GROUP BY ALL", "edges", "rc"))
def _(v):
    m = graph.relation_chunks(v.rels).join(F.broadcast(_edge_hits(v)), ["namespace", "src", "tgt"], "left_semi")
    return m.groupBy("namespace", "src", "tgt").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunk_ids"))


@query("op_j7_chunk_rows", sql(f"SELECT c.chunk_id, c.namespace, c.text, c.doc_id AS source, c.sequence_index, c.sequence_index < n.total - 1 AS has_next, c.page, c.section FROM ch c JOIN (SELECT doc_id, count(*) AS total FROM ch GROUP BY 1) n ON n.doc_id = c.doc_id", "ch"))
def _(v):
    return inspect.chunk_rows(v.chunks, v.chunks)


@query("op_j8_communities_of_seeds", sql(f"SELECT m.namespace, m.community_id, m.entity FROM members m WHERE EXISTS (SELECT 1 FROM members x JOIN {_HITS} h USING (namespace, entity) WHERE x.namespace = m.namespace AND x.community_id = m.community_id) AND NOT EXISTS (SELECT 1 FROM {_HITS} h WHERE h.namespace = m.namespace AND h.entity = m.entity)", "nodes", "members"))
def _(v):
    return graph.expand_communities(F.broadcast(_hits(v)), v.index().communities).select("namespace", "community_id", "entity")


_LISTING = "(SELECT drive_file_id, CASE WHEN ascii(substr(drive_file_id, 8, 1)) % 7 = 0 THEN 'changed' ELSE drive_modified_time END AS modified FROM docs WHERE ascii(substr(drive_file_id, 9, 1)) % 10 <> 0)"
_INDEXED = "(SELECT drive_file_id, drive_modified_time AS modified, status, doc_id FROM docs WHERE ascii(substr(drive_file_id, 9, 1)) % 10 <> 1)"


def _listing(v: Views) -> tuple[DataFrame, DataFrame]:
    """A listing and an index that differ by rule: added, deleted and changed files."""
    code = lambda i: F.ascii(F.substring("drive_file_id", i, 1))
    listing = v.docs.where(code(9) % 10 != 0).select("drive_file_id", F.when(code(8) % 7 == 0, "changed").otherwise(F.col("drive_modified_time")).alias("modified"))
    index = v.docs.where(code(9) % 10 != 1).select("drive_file_id", F.col("drive_modified_time").alias("modified"), "status", "doc_id")
    return listing, index


@query("op_j9_changes", sql(f"SELECT coalesce(a.drive_file_id, b.drive_file_id) AS drive_file_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.modified IS NULL THEN 'deleted' WHEN a.modified <> b.modified OR b.doc_id <> 'gdrive-' || b.drive_file_id OR b.status = 'error' THEN 'modified' ELSE 'unchanged' END AS change FROM {_LISTING} a FULL JOIN {_INDEXED} b ON a.drive_file_id = b.drive_file_id", "docs"))
def _(v):
    return maintenance.detect_changes(*_listing(v))


_GONE = "(SELECT chunk_id FROM ch WHERE ascii(substr(chunk_id, 12, 1)) % 3 <> 0)"


def _gone(v: Views) -> DataFrame:
    return v.chunks.where(F.ascii(F.substring("chunk_id", 12, 1)) % 3 != 0).select("chunk_id")


@query("op_j10_orphan_entities", sql(f"SELECT DISTINCT namespace, entity FROM ec x WHERE chunk_id IN {_GONE} AND NOT EXISTS (SELECT 1 FROM ec y WHERE y.namespace = x.namespace AND y.entity = x.entity AND y.chunk_id NOT IN {_GONE})", "ch", "ec"))
def _(v):
    return maintenance.orphans(graph.entity_chunks(v.ents), ["namespace", "entity"], _gone(v))


@query("op_j10_orphan_relations", sql(f"SELECT DISTINCT namespace, src, tgt FROM rc x WHERE chunk_id IN {_GONE} AND NOT EXISTS (SELECT 1 FROM rc y WHERE y.namespace = x.namespace AND y.src = x.src AND y.tgt = x.tgt AND y.chunk_id NOT IN {_GONE})", "ch", "rc"))
def _(v):
    return maintenance.orphans(graph.relation_chunks(v.rels), ["namespace", "src", "tgt"], _gone(v))


# --- aggregates


@query("op_a1_entity_merge", sql("SELECT namespace, entity, entity_type, mentions FROM nodes", "nodes"))
def _(v):
    return v.nodes.select("namespace", "entity", "entity_type", "mentions")


@query("op_a3_descriptions", sql("SELECT namespace, entity, description FROM nodes", "nodes"))
def _(v):
    return v.nodes.select("namespace", "entity", "description")


@query("op_a2_relation_merge", sql("SELECT * FROM edges", "edges"))
def _(v):
    return v.edges


@query("op_a5_chunk_frequency", sql("SELECT chunk_id, count(*) AS n FROM ec GROUP BY 1", "ec"))
def _(v):
    return graph.entity_chunks(v.ents).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("op_a10_namespace_stats", sql("SELECT namespace, sum(d)::BIGINT AS documents, sum(c)::BIGINT AS chunks, sum(e)::BIGINT AS entities, sum(r)::BIGINT AS relations FROM (SELECT namespace, 1 AS d, 0 AS c, 0 AS e, 0 AS r FROM docs UNION ALL SELECT namespace, 0, 1, 0, 0 FROM ch UNION ALL SELECT namespace, 0, 0, 1, 0 FROM nodes UNION ALL SELECT namespace, 0, 0, 0, 1 FROM edges) GROUP BY 1", "docs", "ch", "nodes", "edges"))
def _(v):
    return inspect.namespace_stats(v.docs, v.chunks, v.nodes, v.edges)


@query("op_a11_chunk_count", sql("SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY 1", "ch"))
def _(v):
    return inspect.chunk_counts(v.chunks)


@query("op_a12_api_call_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE call_type = 'llm') AS llm_calls, count(*) FILTER (WHERE call_type = 'embedding') AS embedding_calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM api_calls")
def _(v):
    return inspect.api_call_stats(v.raw("api_calls"))


@query("op_a13_degree", sql("SELECT namespace, entity, count(*) AS degree FROM (SELECT namespace, src AS entity FROM edges UNION ALL SELECT namespace, tgt FROM edges) GROUP BY ALL", "edges"))
def _(v):
    return graph.degrees(v.edges)


@query("op_a14_mapped_entities", sql(f"SELECT DISTINCT namespace, entity FROM ec WHERE chunk_id IN {_GONE}", "ch", "ec"))
def _(v):
    return graph.entity_chunks(v.ents).join(_gone(v), "chunk_id", "left_semi").select("namespace", "entity").distinct()


# --- ranking, windows, search


_LISTS = "(SELECT 0 AS list_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, doc_id::VARCHAR AS chunk_id FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT 1, row_number() OVER (ORDER BY added_at, doc_id) - 1 AS rank, doc_id::VARCHAR FROM documents)"


def _two_lists(v: Views) -> DataFrame:
    d = v.raw("documents").select("doc_id", "n_chars", "added_at")
    out = None
    for i, (rows, order) in enumerate(((d.where("n_chars is not null"), [F.col("n_chars").desc(), "doc_id"]), (d, ["added_at", "doc_id"]))):
        top = retrieval._ranked(rows, order)
        one = top.select(F.lit(i).alias("list_id"), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"))
        out = one if out is None else out.unionByName(one)
    return out


@query("op_a6_rrf", f"SELECT chunk_id, round(sum(1.0 / (61 + rank)), 9) AS score FROM {_LISTS} GROUP BY 1")
def _(v):
    return fusion.rrf(_two_lists(v)).select("chunk_id", F.round("score", 9).alias("score"))


@query("op_t3_rrf_top", f"SELECT chunk_id, round(s, 9) AS score FROM (SELECT chunk_id, sum(1.0 / (61 + rank)) AS s, min((list_id, rank)) AS f FROM {_LISTS} GROUP BY 1) ORDER BY round(s, 12) DESC, f, chunk_id LIMIT 20")
def _(v):
    return fusion.ordered(fusion.rrf(_two_lists(v)).withColumn("score", F.round("score", 12)), 20).select("chunk_id", F.round("score", 9).alias("score"))


@query("op_a7_first_by_pair", sql("SELECT namespace, a, b, arg_min(relation_id, relation_id) AS first_relation FROM (SELECT namespace, src AS a, tgt AS b, pos AS relation_id FROM rels) GROUP BY ALL", "rels"))
def _(v):
    return fusion.first_by(v.rels.select("namespace", F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("pos").alias("first_relation")), ["namespace", "a", "b"], ["first_relation"])


@query("op_w2_budget_prefix", "SELECT source, doc_id, cost FROM (SELECT source, doc_id, (length(text) + 9) // 4 AS cost, sum((length(text) + 9) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE run <= 4000")
def _(v):
    d = v.raw("documents").where("text is not null and source is not null").select("source", "doc_id", F.floor((F.length("text") + 9) / 4).cast("long").alias("cost"))
    return fusion.budget_prefix(d, "cost", 4000, ["source"], ["doc_id"])


@query("op_w4_sliding_windows", "SELECT doc_id, i AS window, array_to_string(w[i * 76 + 1 : i * 76 + 128], ' ') AS piece FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(0, greatest(0, ceil((len(w) - 128) / 76.0)::INT) + 1)) AS i) WHERE len(w) > 0")
def _(v):
    d = v.raw("documents").where("text is not null").select("doc_id", F.filter(F.split("text", r"[\t\n\f\r ]+"), lambda x: x != "").alias("w"))
    return chunking.sliding_windows(d, "w", 128, 52).select("doc_id", F.col("window").cast("long").alias("window"), F.array_join("piece", " ").alias("piece"))


@query("op_w9_batches", sql("SELECT doc_id, (sequence_index // 5)::INT AS batch, count(*) AS n FROM ch GROUP BY ALL", "ch"))
def _(v):
    return enrich.batch_windows(v.chunks).groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


@query("op_w7_page_map", f"SELECT doc_id, head, max(page)::INT AS page FROM (SELECT doc_id, substr({_STRIP.format('p.text')}, 1, 80) AS head, p.page_number AS page FROM (SELECT doc_id, unnest(pages) AS p FROM parsed_documents)) WHERE head <> '' GROUP BY 1, 2")
def _(v):
    return chunking.page_map(v.raw("parsed_documents"))


_PARAS = "SELECT doc_id, i, p, list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS p FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS x FROM documents WHERE text IS NOT NULL))"
_CUT = "list_transform(range(0, greatest(0, ceil((len(w) - 128) / 112.0)::BIGINT) + 1), lambda j: array_to_string(w[j * 112 + 1 : j * 112 + 128], ' '))"
_PACKED = f"""SELECT doc_id, CASE WHEN r.n > 0 THEN list_append(r.done, r.cur) ELSE r.done END AS done FROM (SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}, list({{'done': {_CUT}, 'cur': p, 'n': len(w)}} ORDER BY i)), lambda a, x: {{
    'done': CASE WHEN x.n > 128 THEN list_concat(CASE WHEN a.n > 0 THEN list_append(a.done, a.cur) ELSE a.done END, x.done) WHEN a.n + x.n <= 128 THEN a.done WHEN a.n > 0 THEN list_append(a.done, a.cur) ELSE a.done END,
    'cur': CASE WHEN x.n > 128 THEN '' WHEN a.n + x.n <= 128 AND a.n > 0 THEN a.cur || chr(10) || chr(10) || x.cur ELSE x.cur END,
    'n': CASE WHEN x.n > 128 THEN 0 WHEN a.n + x.n <= 128 THEN a.n + x.n ELSE x.n END}}) AS r FROM ({_PARAS}) WHERE len(w) > 0 GROUP BY doc_id)"""


@query("op_m14_chunk_flat", f"SELECT doc_id, sequence_index::INT AS sequence_index, 'chunk-' || substr(md5(doc_id::VARCHAR || ':' || text), 1, 12) AS chunk_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INT AS n_words FROM (SELECT doc_id, unnest(range(0, len(done))) AS sequence_index, unnest(done) AS text FROM ({_PACKED}))")
def _(v):
    return chunking.chunk_flat(v.raw("documents").select("doc_id", "text"), 128, 16)


@query("op_m14_chunk_ids", sql("SELECT chunk_id, 'chunk-' || substr(md5(doc_id || ':' || text), 1, 12) AS new_id FROM ch", "ch"))
def _(v):
    return v.chunks.select("chunk_id", T.chunk_id(F.col("doc_id"), F.col("text")).alias("new_id"))


@query("op_t1_vector_topk", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def _(v):
    return vector.vector_topk(v.raw("embeddings"), v.probe(0), 10, "vec_id")


@query("op_p11_threshold", "SELECT vec_id, score FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50) WHERE score >= 0.2")
def _(v):
    return vector.vector_topk(v.raw("embeddings"), v.probe(3), 50, "vec_id", threshold=0.2)


_TOK = "list_filter(string_split_regex(translate(lower(coalesce({}, '')), '" + bm25.accents()[0] + "', '" + bm25.accents()[1] + "'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"
_OCC = "len(list_filter(range(1, len({0}) + 1), lambda i: {0}[i] = 'the' AND {0}[i + 1] = 'cold'))"
_BM = f"""SELECT namespace, chunk_id, round(-(CASE WHEN ln((N - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg)), 6) AS score FROM (SELECT *, count(*) OVER w AS N, count(*) FILTER (WHERE f > 0) OVER w AS n, avg(len) OVER w AS avg FROM (SELECT namespace, chunk_id, len(a) + len(b) + len(c) + len(d) AS len, {_OCC.format('a')} + {_OCC.format('b')} + {_OCC.format('c')} + {_OCC.format('d')} AS f FROM (SELECT namespace, chunk_id, {_TOK.format('text')} AS a, {_TOK.format('keywords')} AS b, {_TOK.format('expanded_keywords')} AS c, {_TOK.format('summary')} AS d FROM ch)) WINDOW w AS (PARTITION BY namespace)) WHERE f > 0"""
_BM = _BM.replace(" AS N,", " AS total_n,").replace("(N - n", "(total_n - n")
_BM3 = _BM.replace("[i + 1] = 'cold'", "[i + 1] = 'cold' AND {0}[i + 2] = 'room'")
for _c in "abcd":  # the phrase of the composed modes: "the cold room"
    _BM3 = _BM3.replace(f"{_c}[i + 1] = 'cold' AND {{0}}", f"{_c}[i + 1] = 'cold' AND {_c}")


def _w6(src: str, k: int) -> str:
    """(rank, chunk_id) of the weighted selection over different (source_rank, chunk_id) rows: the fold over the sources as a list reduction."""
    ranked = f"SELECT source_rank, list(chunk_id ORDER BY f DESC, chunk_id) AS ids FROM ({src}) JOIN (SELECT chunk_id, count(*) AS f FROM ({src}) GROUP BY 1) USING (chunk_id) GROUP BY 1"
    quota = f"SELECT i, ids, greatest(1, floor((n - i) / (n * (n + 1) / 2.0) * greatest({k}, n)))::BIGINT AS q FROM (SELECT *, row_number() OVER (ORDER BY source_rank) - 1 AS i, count(*) OVER () AS n FROM ({ranked}))"
    fold = f"SELECT list_reduce(list_prepend({{'ids': []::VARCHAR[], 'q': 0::BIGINT}}, list({{'ids': ids, 'q': q}} ORDER BY i)), lambda a, x: {{'ids': list_concat(a.ids, list_filter(x.ids, lambda c: NOT list_contains(a.ids, c))[1:x.q]), 'q': 0::BIGINT}}).ids AS ids FROM ({quota})"
    return f"SELECT unnest(range(0, len(ids))) AS rank, unnest(ids) AS chunk_id FROM ({fold})"


@query("op_t2_bm25_phrase", sql(_BM, "ch"))
def _(v):
    return bm25.bm25_phrase(v.chunks, "The cold")


@query("op_t2_postings", sql(f"SELECT namespace, term, count(*) AS n_postings, sum(k)::BIGINT AS n_positions FROM (SELECT namespace, chunk_id, 'text' AS col, unnest({_TOK.format('text')}) AS term, 1 AS k FROM ch UNION ALL SELECT namespace, chunk_id, 'keywords', unnest({_TOK.format('keywords')}), 1 FROM ch UNION ALL SELECT namespace, chunk_id, 'expanded_keywords', unnest({_TOK.format('expanded_keywords')}), 1 FROM ch UNION ALL SELECT namespace, chunk_id, 'summary', unnest({_TOK.format('summary')}), 1 FROM ch) GROUP BY ALL".replace("SELECT namespace, term, count(*) AS n_postings, sum(k)::BIGINT AS n_positions FROM (", "SELECT namespace, term, count(*) AS n_postings, sum(k)::BIGINT AS n_positions FROM (SELECT namespace, term, chunk_id, col, sum(k) AS k FROM (").replace(" FROM ch) GROUP BY ALL", " FROM ch) GROUP BY ALL) GROUP BY namespace, term"), "ch"))
def _(v):
    p = bm25.postings(v.chunks)
    return p.groupBy("namespace", "term").agg(F.count("*").alias("n_postings"), F.sum(F.size("positions")).alias("n_positions"))


@query("op_w6_weighted_selection", sql(_w6(f"SELECT DISTINCT rank AS source_rank, chunk_id FROM ec JOIN {_HITS} USING (namespace, entity)", 30), "nodes", "ec"))
def _(v):
    m = graph.entity_chunks(v.ents).join(F.broadcast(_hits(v)), ["namespace", "entity"])
    return fusion.weighted_rows(m.select(F.col("rank").alias("source_rank"), "chunk_id").distinct(), 30, 10).withColumn("rank", F.col("rank").cast("long"))


# --- retrieval modes


_CV = "(SELECT k.chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM (SELECT DISTINCT chunk_id, " + VEC.format("chunk_id") + " AS vec_id FROM chunks) k JOIN embeddings e USING (vec_id) ORDER BY score DESC, chunk_id LIMIT 10)"


@query("op_r5_naive", f"SELECT row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id FROM {_CV} WHERE score >= 0")
def _naive(v):
    return retrieval.naive(v.index(), v.probe(0), TOP_K).chunks.select("rank", "chunk_id").withColumn("rank", F.col("rank").cast("long"))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return QUERIES["op_r5_naive"](spark, sf_dir)


def _near(keys: str, cols: list[str], probe: int) -> str:
    """(cols, rank) of the ten keys nearest to a probe vector."""
    joined, ident = (f"concat_ws('{c}', {', '.join(cols)})" for c in ("|", "\x1f"))
    score = f"round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {probe})), 6)"
    return f"(SELECT {', '.join(cols)}, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM (SELECT k.*, {ident} AS id, {score} AS score FROM (SELECT *, {VEC.format(joined)} AS vec_id FROM (SELECT DISTINCT {', '.join(cols)} FROM {keys})) k JOIN embeddings e USING (vec_id)) ORDER BY score DESC, id LIMIT {TOP_K}) WHERE score >= 0)"


def _chunks_of(hits: str, mapped: str, cols: list[str]) -> str:
    return _w6(f"SELECT DISTINCT rank AS source_rank, chunk_id FROM {hits} JOIN {mapped} USING ({', '.join(cols)})", TOP_K)


def _rrf(*lists: str) -> str:
    """(rank, chunk_id, score) of the fusion of (rank, chunk_id) lists."""
    u = " UNION ALL ".join(f"SELECT {i} AS list_id, rank, chunk_id FROM ({x})" for i, x in enumerate(lists))
    return f"SELECT row_number() OVER (ORDER BY s DESC, f, chunk_id) - 1 AS rank, chunk_id, round(s, 9) AS score FROM (SELECT chunk_id, sum(1.0::DOUBLE / (61 + rank)) AS s, min((list_id, rank)) AS f FROM ({u}) GROUP BY 1)"


_ENT, _REL = ["namespace", "entity"], ["namespace", "src", "tgt"]
_PHRASE = f"SELECT row_number() OVER (ORDER BY score, chunk_id) - 1 AS rank, chunk_id FROM ({_BM3} ORDER BY score, chunk_id LIMIT {TOP_K})"
_LOCAL = _rrf(_chunks_of(_near("ec", _ENT, 1), "ec", _ENT), _PHRASE)
_GLOBAL = _chunks_of(_near("rc", _REL, 2), "rc", _REL)
_NAIVE = f"SELECT row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id FROM {_CV} WHERE score >= 0"
_SEEDED = f"(SELECT namespace, entity, min(rank) AS rank FROM (SELECT namespace, rank, unnest([src, tgt]) AS entity FROM {_near('rc', _REL, 2)}) GROUP BY ALL)"
_EXPANDED = f"SELECT n.namespace, n.entity, n.entity_type, n.description, x.rank FROM nodes n JOIN (SELECT * FROM {_SEEDED} UNION ALL SELECT DISTINCT m.namespace, m.entity, 1073741824 AS rank FROM members m WHERE (m.namespace, m.community_id) IN (SELECT (namespace, community_id) FROM members JOIN {_SEEDED} USING (namespace, entity)) AND (m.namespace, m.entity) NOT IN (SELECT (namespace, entity) FROM {_SEEDED})) x USING (namespace, entity)"


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("op_r1_local", sql(_LOCAL, "ch", "ec"))
def _(v):
    return _long(retrieval.local(v.index(), v.probe(1), "the cold room", TOP_K).chunks)


@query("op_r2_global", sql(_GLOBAL, "rc"))
def _(v):
    return _long(retrieval.global_(v.index(), v.probe(2), TOP_K).chunks.select("rank", "chunk_id"))


@query("op_r2_global_entities", sql(_EXPANDED, "rc", "nodes", "members"))
def _(v):
    return _long(retrieval.global_(v.index(), v.probe(2), TOP_K).entities)


@query("op_r3_hybrid", sql(_rrf(_LOCAL, _GLOBAL), "ch", "ec", "rc"))
def _(v):
    return _long(retrieval.hybrid(v.index(), v.probe(1), v.probe(2), "the cold room", TOP_K).chunks)


@query("op_r4_mix", sql(_rrf(_rrf(_LOCAL, _GLOBAL), _NAIVE), "ch", "ec", "rc"))
def _(v):
    return _long(retrieval.mix(v.index(), v.probe(0), v.probe(1), v.probe(2), "the cold room", TOP_K).chunks)


@query("op_r6_bypass_retrieve", sql(_LOCAL, "ch", "ec"))
def _(v):
    return _long(retrieval.search(v.index(), "bypass", "the cold room", (v.probe(0), v.probe(1), v.probe(2)), TOP_K).chunks)


_NS = "(SELECT c.namespace, k.chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM ch c JOIN (SELECT DISTINCT chunk_id, " + VEC.format("chunk_id") + " AS vec_id FROM chunks) k USING (chunk_id) JOIN embeddings e USING (vec_id))"


@query("op_r7_namespaces", sql(f"SELECT chunk_id, round(sum(1.0 / (61 + r)), 9) AS score FROM (SELECT namespace, chunk_id, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, chunk_id) - 1 AS r FROM {_NS} QUALIFY r < 10) GROUP BY 1", "ch"))
def _(v):
    ix = v.index()
    ix.chunk_vectors = v.chunks.select("namespace", "chunk_id").join(ix.chunk_vectors, "chunk_id")
    names = sorted(r.namespace for r in v.chunks.select("namespace").distinct().collect())
    lists = {n: retrieval.naive(retrieval.of_namespace(ix, n), v.probe(0), TOP_K, None).chunks for n in names}
    return retrieval.fuse_namespaces(lists).select("chunk_id", "score")


@query("op_r10_context_items", sql("SELECT namespace, entity, cost FROM (SELECT namespace, entity, cost, sum(cost) OVER (ORDER BY mentions DESC, namespace, entity ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT namespace, entity, mentions, ((length(entity) + length(entity_type) + 40) // 4)::BIGINT AS cost FROM nodes)) WHERE run <= 4000", "nodes"))
def _(v):
    n = v.nodes.select("namespace", "entity", "mentions", F.floor((F.length("entity") + F.length("entity_type") + 40) / 4).cast("long").alias("cost"))
    return fusion.budget_prefix(n, "cost", 4000, [], [F.col("mentions").desc(), "namespace", "entity"], least=10).select("namespace", "entity", "cost")


_ANS = "(SELECT doc_id, text || ' [1] and [2][11], again [1].' AS answer FROM documents WHERE text IS NOT NULL)"


@query("op_r11_citations", f"SELECT doc_id, ref FROM (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS INT) AS ref FROM {_ANS}) WHERE ref BETWEEN 1 AND 10")
def _(v):
    a = v.raw("documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" [1] and [2][11], again [1].")).alias("answer"))
    return a.select("doc_id", F.explode(F.array_distinct(T.citation_refs(F.col("answer")))).alias("ref")).where(F.col("ref").between(1, 10))


@query("op_r11_strip_citations", f"SELECT doc_id, regexp_replace(answer, '\\s*\\[\\d+\\]', '', 'g') AS answer FROM {_ANS}")
def _(v):
    a = v.raw("documents").where("text is not null").select("doc_id", F.concat("text", F.lit(" [1] and [2][11], again [1].")).alias("answer"))
    return a.select("doc_id", T.without_citations(F.col("answer")).alias("answer"))


@query("op_j13_cited_documents", sql("SELECT a.id, coalesce(d.name, '') AS name, coalesce(d.url, '') AS url FROM api_calls a LEFT JOIN ch c USING (chunk_id) LEFT JOIN docs d ON d.doc_id = c.doc_id", "ch", "docs"))
def _(v):
    a = v.raw("api_calls").select("id", "chunk_id")
    return a.join(v.chunks.select("chunk_id", "doc_id"), "chunk_id", "left").join(v.docs.select("doc_id", "name", "url"), "doc_id", "left").select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("url"))


# --- ingestion and mutation


@query("op_m1_upsert_documents", sql("SELECT doc_id, name, status, file_size FROM docs", "docs"))
def _(v):
    return v.docs.select("doc_id", "name", "status", "file_size")


@query("op_m2_reset_stuck", sql("SELECT doc_id, CASE WHEN status = 'processing' THEN 'error' ELSE status END AS status FROM docs", "docs"))
def _(v):
    return maintenance.reset_stuck(v.docs).select("doc_id", "status")


@query("op_m3_insert_chunks", sql("SELECT chunk_id, doc_id, sequence_index, page, section FROM ch", "ch"))
def _(v):
    return v.chunks.select("chunk_id", "doc_id", "sequence_index", "page", "section")


@query("op_m4_entity_chunk_pairs", sql("SELECT * FROM ec", "ec"))
def _(v):
    return graph.entity_chunks(v.ents)


@query("op_m4_relation_chunk_pairs", sql("SELECT * FROM rc", "rc"))
def _(v):
    return graph.relation_chunks(v.rels)


@query("op_m5_delete_mappings", sql(f"SELECT * FROM ec WHERE chunk_id NOT IN {_GONE}", "ch", "ec"))
def _(v):
    return graph.entity_chunks(v.ents).join(_gone(v), "chunk_id", "left_anti").select("namespace", "entity", "chunk_id")


_DEL = "(SELECT doc_id FROM docs WHERE ascii(substr(doc_id, 12, 1)) % 4 = 0)"


@query("op_m6_delete_documents", sql(f"SELECT 'chunks' AS part, count(*) AS n FROM ch WHERE doc_id NOT IN {_DEL} UNION ALL SELECT 'orphan_entities', count(*) FROM (SELECT DISTINCT namespace, entity FROM ec WHERE chunk_id IN (SELECT chunk_id FROM ch WHERE doc_id IN {_DEL}) EXCEPT SELECT namespace, entity FROM ec WHERE chunk_id NOT IN (SELECT chunk_id FROM ch WHERE doc_id IN {_DEL}))", "docs", "ch", "ec"))
def _(v):
    ids = v.docs.where(F.ascii(F.substring("doc_id", 12, 1)) % 4 == 0).select("doc_id")
    left = maintenance.delete_documents(v.chunks, graph.entity_chunks(v.ents), graph.relation_chunks(v.rels), ids)
    return left["chunks"].agg(F.lit("chunks").alias("part"), F.count("*").alias("n")).unionByName(left["orphan_entities"].agg(F.lit("orphan_entities").alias("part"), F.count("*").alias("n")))


@query("op_m7_remove_nodes", sql("SELECT namespace, src, tgt, weight FROM edges WHERE (namespace, src) NOT IN (SELECT (namespace, entity) FROM nodes WHERE entity_type = 'concept') AND (namespace, tgt) NOT IN (SELECT (namespace, entity) FROM nodes WHERE entity_type = 'concept')", "nodes", "edges"))
def _(v):
    n = v.nodes
    return graph.remove_nodes(n, v.edges, n.where("entity_type = 'concept'"))[1].select("namespace", "src", "tgt", "weight")


@query("op_m9_communities")
def _(v):
    return graph.communities(v.edges)


@query("op_m10_ingest_action", sql("SELECT n.doc_id, CASE WHEN d.status = 'processing' THEN 'skip_processing' WHEN d.content_hash IS NULL THEN 'index' WHEN d.content_hash = n.content_hash AND d.status <> 'error' THEN 'metadata_only' ELSE 'reindex' END AS action FROM (SELECT doc_id, CASE WHEN ascii(substr(doc_id, 12, 1)) % 3 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM docs) n LEFT JOIN (SELECT * FROM docs WHERE ascii(substr(doc_id, 13, 1)) % 5 <> 0) d USING (doc_id)", "docs"))
def _(v):
    c = lambda i: F.ascii(F.substring("doc_id", i, 1))
    new = v.docs.select("doc_id", F.when(c(12) % 3 == 0, "new").otherwise(F.col("content_hash")).alias("content_hash"))
    return maintenance.ingest_action(new, v.docs.where(c(13) % 5 != 0))


@query("op_m11_refresh_metadata", sql("SELECT doc_id, CASE WHEN ascii(substr(doc_id, 12, 1)) % 2 = 0 THEN 'renamed' ELSE name END AS name, url FROM docs", "docs"))
def _(v):
    new = v.docs.select("doc_id", F.when(F.ascii(F.substring("doc_id", 12, 1)) % 2 == 0, "renamed").otherwise("").alias("name"), F.lit("").alias("url"))
    return maintenance.refresh_metadata(v.docs, new, ["name", "url"]).select("doc_id", "name", "url")


@query("op_m13_stale_chunks", sql("SELECT chunk_id FROM ch WHERE doc_id IN (SELECT doc_id FROM ch WHERE sequence_index % 2 = 0) AND chunk_id NOT IN (SELECT chunk_id FROM ch WHERE sequence_index % 2 = 0)", "ch"))
def _(v):
    return maintenance.stale_chunks(v.chunks, v.chunks.where("sequence_index % 2 = 0")).select("chunk_id")


@query("op_m15_embedding_text", sql("SELECT chunk_id, CASE WHEN json_valid(keywords) AND json_array_length(keywords) > 0 THEN text || chr(10) || chr(10) || 'Contextual keywords: ' || array_to_string(from_json(keywords, '[\"VARCHAR\"]'), ', ') ELSE text END AS embedded FROM ch", "ch"))
def _(v):
    return v.chunks.select("chunk_id", enrich.embedding_text(F.col("text"), T.json_list(F.col("keywords"))).alias("embedded"))


@query("op_a9_keyword_merge", sql("SELECT chunk_id, array_to_string(list_reduce(list_prepend(CASE WHEN json_valid(keywords) THEN from_json(keywords, '[\"VARCHAR\"]') ELSE [] END, list_transform(string_split(category, '_'), lambda k: [k])), lambda a, k: CASE WHEN trim(k[1]) = '' OR list_contains(list_transform(a, lambda y: lower(trim(y))), lower(trim(k[1]))) THEN a ELSE list_append(a, trim(k[1])) END), ',') AS keywords FROM ch", "ch"))
def _(v):
    return v.chunks.select("chunk_id", F.array_join(enrich.merge_keywords(T.json_list(F.col("keywords")), F.split("category", "_")), ",").alias("keywords"))


@query("op_a8_gleaning", f"SELECT chunk_id, k, arg_min(name, (turn, ordinal, name)) AS name, arg_min(turn, (turn, ordinal, name))::INT AS turn FROM (SELECT DISTINCT chunk_id, {_key('name')} AS k, name, ordinal % 2 AS turn, ordinal FROM entity_extractions WHERE name IS NOT NULL) GROUP BY 1, 2")
def _(v):
    e = v.raw("entity_extractions").where("name is not null").distinct()
    return enrich.glean_entities(e.where("ordinal % 2 = 0").select("chunk_id", "ordinal", "name"), e.where("ordinal % 2 = 1").select("chunk_id", "ordinal", "name"))


@query("op_fn_estimate_tokens", sql("SELECT chunk_id, length(text) // 4 AS est_tokens FROM ch", "ch"))
def _(v):
    return v.chunks.select("chunk_id", T.estimate_tokens(F.col("text")).alias("est_tokens"))
