"""The engine from files to answers, and synchronisation by micro-batches."""

import json

from docmill.config import load
from docmill.engine import Engine, NamespaceNotFound, parse_keywords
from docmill.providers import CannedCompleter, ExternalAPIError, HashEmbedder
from docmill.sources.files import pdf_sections
from docmill.streaming.sync import SyncResult, call_log, poll_listings, sync_namespace


def _engine(spark, path):
    reply = json.dumps({"entities": [{"name": "Ada", "type": "person", "description": "writes"}, {"name": "Engine", "type": "product", "description": "runs"}], "relationships": [{"source": "Ada", "target": "Engine", "keywords": "built", "description": "built it"}], "keywords": ["engine"], "summary": "s"})
    return Engine(spark, str(path), load(), HashEmbedder(16), CannedCompleter({"Read the passage": reply, "Reply with JSON": '{"high_level": ["engine"], "low_level": ["Ada"]}', "Answer from": "It was Ada [1]."}))


def test_ingest_query_delete(spark, tmp_path):
    e = _engine(spark, tmp_path / "store")
    docs = spark.createDataFrame([("gdrive-1", "ns", "one.txt", "h1", "Ada built the engine.\n\nIt runs."), ("gdrive-2", "ns", "two.txt", "h2", "Nothing to see.")], "doc_id string, namespace string, name string, content_hash string, text string")
    e.ingest(docs)
    assert e.store.read("chunks").count() == 2
    e.ingest(docs)  # nothing changed
    assert e.store.read("chunks").count() == 2
    for mode in ("naive", "local", "global", "hybrid", "mix"):
        assert e.retrieve("Ada built", mode, 3).chunks.count() >= 1, mode
    out = e.query("Ada built", "mix", 3)
    assert out["answer"] == "It was Ada." and out["sources"] and out["chunks"]
    e.delete_document("gdrive-1")
    assert [r.doc_id for r in e.store.read("chunks").collect()] == ["gdrive-2"]
    try:
        e.index(["nowhere"])
        raise AssertionError
    except NamespaceNotFound:
        pass


def test_every_namespace_has_its_list(spark, tmp_path):
    e = _engine(spark, tmp_path / "store")
    # three chunks of "big" are nearer to the question than the one of "small"
    docs = [(f"gdrive-{i}", "big", f"{i}.txt", f"h{i}", "Ada built " + "it " * i) for i in range(3)] + [("gdrive-9", "small", "9.txt", "h9", "Ada built quite another thing in the far north")]
    e.ingest(spark.createDataFrame(docs, "doc_id string, namespace string, name string, content_hash string, text string"))
    for names in (None, ["big", "small"]):
        got = e.retrieve("Ada built", "naive", 2, names).chunks.orderBy("rank").collect()
        assert [r.namespace for r in got] == ["big", "small", "big"]
        assert got[0].score == got[1].score == round(1 / 61, 9) and got[2].score == round(1 / 62, 9)


def test_sections_context_and_gleaning(spark, tmp_path):
    first = json.dumps({"entities": [{"name": "Ada"}], "relationships": [{"source": "Ada", "target": "Engine"}], "keywords": ["engine"], "summary": "s"})
    more = json.dumps({"entities": [{"name": "ADA"}, {"name": "Engine"}], "relationships": [{"source": "engine", "target": "ada"}, {"source": "Engine", "target": "Mill"}]})
    e = Engine(spark, str(tmp_path / "store"), load({"ingestion": {"enable_gleaning": True}}), HashEmbedder(16), CannedCompleter({"Read the passage": first, "may have missed": more, "For each of these": "history, Engine\n---\nmill"}))
    docs = [("d", "ns", "a.md", "h", "x", [("Top", "one two", 1), ("Deep", "three", 3), ("Next", "four", 1)], [(1, "one two"), (2, "four")])]
    e.ingest(spark.createDataFrame(docs, "doc_id string, namespace string, name string, content_hash string, text string, sections array<struct<heading:string,text:string,level:int>>, pages array<struct<page_number:int,text:string>>"))
    got = e.store.read("chunks").orderBy("sequence_index").collect()
    assert [(r.text, r.section, r.page, r.token_count) for r in got] == [("[Top] one two", "Top", 1, 3), ("[Top > Deep] three", "Top > Deep", None, 4), ("[Next] four", "Next", 2, 2)]
    assert [json.loads(r.keywords) for r in got] == [["engine", "history"], ["engine", "mill"], ["engine"]]
    x = e.store.read("enrichments").first()
    assert [a.name for a in x.entities] == ["Ada", "Engine"] and [(a.source, a.target) for a in x.relationships] == [("Ada", "Engine"), ("Engine", "Mill")]


def test_pdf_sections():
    spans = [(16, "Big"), (10, "x" * 50), (13, "Mid"), (10, "tail")]
    assert pdf_sections(spans, "Big\n" + "x" * 50 + "\nMid\ntail") == [{"heading": "Big", "text": "x" * 50, "level": 1}, {"heading": "Mid", "text": "tail", "level": 2}]


def test_keyword_fallback():
    assert parse_keywords("no json", "q") == ([], ["q"])
    assert parse_keywords('```json\n{"high_level": ["a"], "low_level": []}\n```', "q") == (["a"], [])


def test_poll_listings(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"drive_file_id": "a", "modified": "1", "namespace": "n"}\n')
    seen = []
    index = spark.createDataFrame([("b", "1", "indexed", "gdrive-b")], "drive_file_id string, modified string, status string, doc_id string")
    q = poll_listings(spark, str(src), lambda: index, lambda ch, i: seen.extend((r.drive_file_id, r.change) for r in ch.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [("a", "added"), ("b", "deleted")]


def test_call_log(spark, tmp_path):
    calls = spark.read.parquet("/root/testdata/sf0.001/api_calls.parquet")
    s = spark.readStream.schema(calls.schema).parquet("/root/testdata/sf0.001/api_calls.parquet*")
    q = call_log(s, "1000 days").writeStream.format("memory").queryName("log").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(calls) FROM log").first()[0] == calls.count()


def test_summary_calls_and_one_reply(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    class Counting(CannedCompleter):
        def complete(self, prompt, system=None):
            if "Read the passage" in prompt:
                asked.add(1)
            return super().complete(prompt, system)

    reply = lambda i: json.dumps({"entities": [{"name": "Ada", "type": "person", "description": f"does {i}"}], "keywords": [], "summary": ""})
    e = Engine(spark, str(tmp_path / "store"), load({"ingestion": {"enable_llm_summary": True, "min_descriptions": 3, "enable_contextual": False}, "model": "m"}), HashEmbedder(8), Counting({"Write one short": "Ada does much", **{f"text {i}": reply(i) for i in range(4)}}))
    e.ingest(spark.createDataFrame([(f"d{i}", "a" if i < 3 else "b", f"{i}.txt", "h", f"text {i}") for i in range(4)], "doc_id string, namespace string, name string, content_hash string, text string"))
    assert asked.value == 4
    assert {(r.namespace, r.description) for r in e.index().nodes.collect()} == {("a", "Ada does much"), ("b", "does 3")}
    calls = e.store.read("api_calls")
    assert {(r.call_type, r.operation): r["count"] for r in calls.groupBy("call_type", "operation").count().collect()} == {("llm", "extract"): 4, ("embedding", "embed_chunks"): 4}
    assert calls.select("id").distinct().count() == 8
    e.delete_document("d3")
    assert {r.namespace for r in e.store.read("entity_vectors").collect()} == {"a"}


def test_sync_order_and_abort(spark):
    index = lambda: spark.createDataFrame([("a", "1", "indexed", "gdrive-a"), ("b", "1", "indexed", "gdrive-b")], "drive_file_id string, modified string, status string, doc_id string")
    files = {"x": [("a", "2")], "y": [("c", "1")]}
    seen = []

    def listing(f):
        if f == "broken":
            raise OSError
        return spark.createDataFrame(files[f], "drive_file_id string, modified string")

    take = lambda c, *a: seen.extend((r.drive_file_id, r.change, *a) for r in c.collect())
    assert sync_namespace("n", ["x", "broken"], listing, index, take, take).aborted and not seen
    got = sync_namespace("n", ["x", "y"], listing, index, take, take)
    assert seen == [("b", "deleted"), ("a", "modified", True), ("c", "added", False)] and (got.added, got.updated, got.deleted) == (1, 1, 1)

    def fail(c, force):
        raise ExternalAPIError

    assert sync_namespace("n", ["x", "y"], listing, index, take, fail) == SyncResult("n", 0, 0, 1, True)
