"""Operators against small plain-Python models and hand-made cases."""

import io
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill import config
from docmill.functions import text as T
from docmill.operators import bm25, chunking, context, enrich, fusion, graph, maintenance
from docmill.operators.latest import last_per_key, upsert
from docmill.plans import catalog
from docmill.progress import DocumentProgress, SyncProgress
from docmill.sources import files


def test_rrf_model(spark):
    rnd = random.Random(1)
    lists = [rnd.sample([f"c{i}" for i in range(30)], 12) for _ in range(3)]
    lists[0][2] = ""
    rows = [(i, r, c) for i, x in enumerate(lists) for r, c in enumerate(x)]
    want: dict = {}
    for i, x in enumerate(lists):
        for r, c in enumerate(x):
            if c:
                want[c] = want.get(c, 0.0) + 1 / (61 + r)
    got = {r.chunk_id: r.score for r in fusion.rrf(spark.createDataFrame(rows, "list_id int, rank int, chunk_id string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def _weighted(sources, k, least):
    n = len(sources)
    freq: dict = {}
    for s in sources:
        for c in s:
            freq[c] = freq.get(c, 0) + 1
    budget, ws, out = max(k, n * least), [max(1, n - i) for i in range(n)], []
    for s, w in zip(sources, ws):
        q = max(least, int(w / sum(ws) * budget))
        out += [c for c in sorted(s, key=lambda c: (-freq[c], s.index(c))) if c not in out][:q]
    return out


def test_weighted_selection_model(spark):
    rnd = random.Random(2)
    for _ in range(3):
        src = [rnd.sample([f"c{i:02d}" for i in range(20)], rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 6))]
        df = spark.createDataFrame([(i, s) for i, s in enumerate(src)], "source_rank int, chunk_ids array<string>")
        got = [r.chunk_id for r in fusion.weighted_selection(df, 7).orderBy("rank").collect()]
        assert got == _weighted(src, 7, 1)


def test_weighted_rows_model(spark):
    rnd = random.Random(5)
    # a hot source whose shared ids come after its first 500
    cases = [[sorted(f"c{i:04d}" for i in range(900)), [f"c{i:04d}" for i in range(850, 900)], ["c0001"]]]
    cases += [[sorted(rnd.sample([f"c{i:02d}" for i in range(60)], rnd.randrange(1, 50))) for _ in range(rnd.randrange(1, 6))] for _ in range(3)]
    for src in cases:
        df = spark.createDataFrame([(2 * i, c) for i, s in enumerate(src) for c in s], "source_rank int, chunk_id string")
        got = [r.chunk_id for r in fusion.weighted_rows(df, 7, 6).orderBy("rank").collect()]
        assert got == _weighted(src, 7, 1)


def test_w6_counts_every_chunk_of_a_hot_entity(spark, tmp_path):
    ents = [(i, "n", f"c{i:04d}", "Hot", "t", "") for i in range(600)] + [(600 + i, "n", f"c{i:04d}", "Cold", "t", "") for i in range(590, 600)]
    spark.createDataFrame(ents, "extraction_id long, namespace string, chunk_id string, name string, type string, description string").write.parquet(str(tmp_path / "entity_extractions.parquet"))
    got = [r.chunk_id for r in catalog.QUERIES["op_w6_weighted_selection"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == _weighted([[f"c{i:04d}" for i in range(600)], [f"c{i:04d}" for i in range(590, 600)]], 30, 1)


def test_budget_prefix_is_maximal(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 7, 3, 9, 1])], "rank int, cost int")
    assert [r.rank for r in fusion.budget_prefix(df, "cost", 15, [], ["rank"]).collect()] == [0, 1, 2]
    assert fusion.budget_prefix(df, "cost", 4, [], ["rank"]).count() == 0


def test_bm25_like_fts5(spark):
    docs = [("a", "the quick brown fox", '["fox"]', "[]", ""), ("b", "brown the quick quick", "[]", "[]", "quick brown dog"), ("c", "nothing here at all", "[]", "[]", None), ("d", "snake_case quick brown quick brown", "[]", "[]", "x"), ("e", "Étion für Ångström; ЖЁЛТЫЙ дом, naı̈ve cafe\u0301", "[]", "[]", ""), ("g", "etion fur angstrom", "[]", "[]", "café желтый дом"), ("f", "dolor", "[]", "[]", "")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, a, b, c, d)")
    con.executemany("INSERT INTO t VALUES (?,?,?,?,?)", [(i, *[x or "" for x in r]) for i, *r in docs])
    df = spark.createDataFrame([("n", *r) for r in docs], "namespace string, chunk_id string, text string, keywords string, expanded_keywords string, summary string")
    for q in ("quick brown", "fox", "brown quick", "quick quick", "étion FÜR", "жёлтый дом", "café", "Angstrom"):
        want = {i: round(s, 6) for i, s in con.execute("SELECT id, bm25(t, 0, 1, 1, 1, 1) FROM t WHERE t MATCH ?", (f'"{q}"',))}
        got = {r.chunk_id: r.score for r in bm25.bm25_phrase(df, q).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want), q
    assert bm25.bm25_phrase(df, " ?! ").count() == 0


def _pack(paras, size, overlap):
    out, cur, n = [], [], 0
    for p in paras:
        w = p.split()
        if len(w) > size:
            if cur:
                out.append("\n\n".join(cur))
            cur, n, s = [], 0, 0
            while True:
                out.append(" ".join(w[s : s + size]))
                if s + size >= len(w):
                    break
                s += size - overlap
        elif n + len(w) <= size:
            cur.append(p)
            n += len(w)
        else:
            out.append("\n\n".join(cur))
            cur, n = [p], len(w)
    return out + (["\n\n".join(cur)] if cur else [])


def test_pack_paragraphs_model(spark):
    rnd = random.Random(3)
    cases = [[" ".join(f"w{i}" for i in range(k)) for k in ks] for ks in ([10], [10, 1], [11], [1, 11, 1], [25, 3, 3, 3, 3], [], [rnd.randrange(1, 30) for _ in range(12)])]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "i int, p array<string>")
    got = {r.i: r.s for r in df.select("i", chunking.pack_paragraphs(F.col("p"), 10, 3).alias("s")).collect()}
    for i, p in enumerate(cases):
        assert got[i] == _pack(p, 10, 3), i


def test_markdown_and_heading_stack(spark):
    md = "preamble\n# A\none\n### B\ntwo\n### C\nthree\n# Empty\n## D\nfour"
    df = spark.createDataFrame([(1, md), (2, None), (3, "no heads")], "doc_id int, text string")
    s = chunking.markdown_sections(df)
    assert [(r.heading, r.level, r.body) for r in s.orderBy("section").collect()] == [("A", 1, "one"), ("B", 3, "two"), ("C", 3, "three"), ("D", 2, "four")]
    assert [r.path for r in chunking.heading_paths(s).orderBy("section").collect()] == ["A", "A > B", "A > B > C", "A > D"]


def test_plaintext_sections(spark):
    df = spark.createDataFrame([(1, "Intro\n\nSome words that are a line of text.\n\nOutlook\n\nMore."), (2, "Only one\n\nSome words, no other heading."), (3, "Ends with stop.\n\nx")], "doc_id int, text string")
    assert [r.heading for r in chunking.plaintext_sections(df).where("doc_id = 1").orderBy("line").collect()] == ["Intro", "Outlook"]
    assert chunking.plaintext_sections(df).where("doc_id = 2").count() == 0


def test_descriptions_and_types(spark):
    rows = [(i, "n", "c", "E" if i % 2 else " e ", t, d) for i, (t, d) in enumerate([("b", "x"), ("a", "y"), ("a", ""), ("b", "x"), ("c", "z"), ("c", "w"), (None, None)])]
    occ = graph.entity_occurrences(spark.createDataFrame(rows, "extraction_id long, namespace string, chunk_id string, name string, type string, description string"))
    n = graph.merge_entities(occ).collect()
    assert len(n) == 1 and n[0].entity == "e" and n[0].entity_type == "b" and n[0].description == "x | y | z (+1 more)"
    arr = spark.createDataFrame([(["b", "a", "b", "", "c"],), ([],)], "d array<string>")
    assert [r[0] for r in arr.select(graph.merge_descriptions(F.col("d"))).collect()] == ["b | a | c", ""]


def test_louvain_two_cliques():
    pairs = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    c = graph.louvain(pairs)
    assert len({c[x] for x in "abcd"}) == 1 and len({c[x] for x in "wxyz"}) == 1 and c["a"] != c["z"]


def test_louvain_at_every_size(spark):
    # a namespace above two million edges (it went to label propagation): a ring of dense groups
    n, size = 12_000, 20
    g = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(size * (size - 1) - 1))).alias("p"), "id").withColumn("x", (F.col("p") / (size - 1)).cast("int")).withColumn("y", F.col("p") % (size - 1)).where("x > y")
    name = lambda i, x: F.format_string("%05d-%02d", i, x)
    e = g.select(F.lit("big").alias("namespace"), name(F.col("id"), F.col("x")).alias("src"), name(F.col("id"), F.col("y").cast("int")).alias("tgt"), F.lit(1.0).alias("weight"))
    e = e.unionByName(spark.range(n).select(F.lit("big").alias("namespace"), name(F.col("id"), F.lit(0)).alias("src"), name((F.col("id") + 1) % n, F.lit(1)).alias("tgt"), F.lit(1.0).alias("weight")))
    assert e.count() > 2_000_000
    c = graph.communities(e).withColumn("g", F.substring("entity", 1, 5))
    assert {r.method for r in c.select("method").distinct().collect()} == {"louvain"}
    per = c.groupBy("g").agg(F.countDistinct("community_id").alias("k"), F.count("*").alias("m")).agg(F.max("k"), F.sum("m")).first()
    assert tuple(per) == (1, n * size)


def test_reply_parsing(spark):
    good = '```json\n{"entities":[{"name":" Ada ","type":"Person"},{"name":" "}],"relationships":[{"source":"A","target":"a"},{"source":"A","target":"B"}],"keywords":["k"],"summary":"s"}\n```'
    rows = spark.createDataFrame([(1, good), (2, "{broken"), (3, None), (4, "{}")], "i int, r string").select("i", enrich.parse_reply(F.col("r")).alias("x")).orderBy("i").collect()
    assert [(e.name, e.type) for e in rows[0].x.entities] == [("Ada", "person")] and len(rows[0].x.relationships) == 1
    assert all(not r.x.entities and r.x.summary == "" for r in rows[1:])


def test_keyword_merge_and_batch_reply(spark):
    df = spark.createDataFrame([(["A", "b"], [" a", "c", "C", ""]), (None, ["x"])], "k array<string>, e array<string>")
    assert [r[0] for r in df.select(enrich.merge_keywords(F.col("k"), F.col("e"))).collect()] == [["A", "b", "c"], ["x"]]
    s = spark.createDataFrame([("one --- \n---\ntwo",)], "r string").select(enrich.split_batch_reply(F.col("r"), 3)).first()[0]
    assert s == ["one", "two", ""]


def test_changes_and_orphans(spark):
    listing = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "9"), ("e", "1")], "drive_file_id string, modified string")
    index = spark.createDataFrame([("b", "2", "indexed", "gdrive-b"), ("c", "3", "indexed", "gdrive-c"), ("d", "1", "indexed", "gdrive-d"), ("e", "1", "error", "gdrive-e")], "drive_file_id string, modified string, status string, doc_id string")
    got = {r.drive_file_id: r.change for r in maintenance.detect_changes(listing, index).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted", "e": "modified"}
    m = spark.createDataFrame([("n", "x", "1"), ("n", "y", "1"), ("n", "y", "2")], "namespace string, entity string, chunk_id string")
    gone = spark.createDataFrame([("1",)], "chunk_id string")
    assert [r.entity for r in maintenance.orphans(m, ["namespace", "entity"], gone).collect()] == ["x"]


def test_upsert_and_last(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in last_per_key(df, ["k"], ["t"]).collect()) == [(1, "b"), (2, "c")]
    new = spark.createDataFrame([(2, "n", 5)], "k int, v string, t int")
    assert upsert(df, new, ["k"]).where("k = 2").count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("d", "see [1] and [2][11]. ", "\u00a0 Ab \n"), ("", "none", "")], "d string, a string, n string")
    r = df.select(T.citation_refs(F.col("a")).alias("c"), T.without_citations(F.col("a")).alias("w"), T.entity_key(F.col("n")).alias("k"), T.chunk_id(F.col("d"), F.col("a")).alias("i")).collect()
    assert r[0].c == [1, 2, 11] and r[0].w == "see and. " and r[0].k == "ab" and r[1].c == []
    assert r[0].i != r[1].i and len(r[0].i) == 18


def test_context(spark):
    e = spark.createDataFrame([("a", "t", "d", 0), ("b", "t", "x" * 100, 1)], "entity string, type string, description string, rank int")
    assert context.block(e, ["entity", "type", "description"], "E:", 15).first()[0].startswith('E:\n[{"entity":"a"')
    empty = e.where("false")
    none = spark.createDataFrame([], "source string, target string, description string, rank int")
    ch = spark.createDataFrame([], "source string, namespace string, text string, rank int")
    assert context.build_context(empty, none, ch) == context.NOTHING


def test_config_and_progress():
    s = config.load({"retrieval": {"top_k": "${K:7}"}, "other": 1}, {})
    assert s.retrieval.top_k == 7 and s.retrieval.default_mode == "mix"
    with pytest.raises(ValueError):
        config.load({"chunking": {"overlap_tokens": 512}})
    p = SyncProgress(4, 1, {"a": DocumentProgress("a", "enriching", 1, 2)})
    assert p.percent == int((100 + 5 + 5 + 22) / 4) and SyncProgress().percent == 0


def test_files(spark, tmp_path):
    b = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "b.md").write_bytes(b"# T\r\nbody \xff")
    (tmp_path / "c.xyz").write_bytes(b"?")
    got = {r.filename: r for r in files.parse_files(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "Head\n\none\n\ntwo" and got["a.docx"].sections[0].text == "one\ntwo" and got["a.docx"].sections[0].level == 2
    assert "\ufffd" in got["b.md"].text and got["c.xyz"].error and got["c.xyz"].text is None
    assert files.pdf_headings([(10, "x" * 50), (16, "Big"), (13, "Mid"), (11, "Low")]) == [("Big", 1), ("Mid", 2), ("Low", 3)]
