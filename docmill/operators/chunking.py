"""Sections and token-bounded chunks of documents, as JVM-side expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import chunk_id, let, strip

MAX_TOKENS, OVERLAP = 512, 50


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def sliding_windows(df: DataFrame, tokens: str, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (…, window, start, piece): steps of size - overlap, until a window reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")
    step = size - overlap
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return df.where(n > 0).withColumn("window", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("window") * step).withColumn("piece", F.slice(tokens, F.col("start") + 1, F.lit(size)))


def pack_paragraphs(paragraphs: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Segments of a text's paragraphs: they are joined while they fit, a longer one is cut into windows by itself."""
    step = size - overlap

    def windows(p: Column) -> Column:
        last = lambda w: F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")
        return let(words(p), lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def flush(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])

    def add(a: Column, p: Column) -> Column:
        k = F.size(words(p))
        fits = a["n"] + k <= size
        long = k > size
        done = F.when(long, F.concat(flush(a), windows(p))).when(fits, a["done"]).otherwise(flush(a))
        cur = F.when(long, F.lit("")).when(fits & (a["n"] > 0), F.concat(a["cur"], F.lit("\n\n"), p)).otherwise(p)
        n = F.when(long, F.lit(0)).when(fits, a["n"] + k).otherwise(k)
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    return F.aggregate(F.filter(paragraphs, lambda p: F.size(words(p)) > 0), zero, add, flush)


def chunk_flat(docs: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, sequence_index, chunk_id, text, n_words) of documents without sections."""
    seg = pack_paragraphs(F.split("text", r"\n\s*\n"), size, overlap)
    out = docs.where("text is not null").select("doc_id", F.posexplode(seg).alias("sequence_index", "text"))
    return out.select("doc_id", "sequence_index", chunk_id(F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id"), "text", F.size(words(F.col("text"))).alias("n_words"))


def chunk_documents(docs: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The documents' rows by chunk, with (sequence_index, chunk_id, text, section, page, token_count) in place of (text, sections, pages).

    A document with sections is cut within them and each chunk begins with its
    heading path in brackets; one without is cut as flat text. A chunk has the
    page whose first 80 characters it begins with.
    """
    for c, t in (("sections", "array<struct<heading:string,text:string,level:int>>"), ("pages", "array<struct<page_number:int,text:string>>")):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(t))
    none = F.lit(None).cast("string")
    pack = lambda t: pack_paragraphs(F.transform(F.split(t, r"\n\s*\n"), strip), size, overlap)
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<path:string,text:string>>").alias("out"))

    def push(a: Column, x: Column) -> Column:
        level = F.coalesce(x["level"], F.lit(0))
        kept = F.when(level > 0, F.slice(a["stack"], F.lit(1), F.least(F.size(a["stack"]), F.greatest(F.lit(0), level - 1)))).otherwise(a["stack"])
        stack = F.when(F.coalesce(x["heading"], F.lit("")) != "", F.concat(kept, F.array(x["heading"]))).otherwise(kept)
        return F.struct(stack.alias("stack"), F.concat(a["out"], F.array(F.struct(F.array_join(stack, " > ").alias("path"), F.coalesce(x["text"], F.lit("")).alias("text")))).alias("out"))

    cut = F.flatten(F.transform(F.aggregate("sections", zero, push, lambda a: a["out"]), lambda s: F.transform(pack(s["text"]), lambda t: F.struct(F.nullif(s["path"], F.lit("")).alias("section"), t.alias("segment")))))
    flat = F.transform(pack(F.col("text")), lambda t: F.struct(none.alias("section"), t.alias("segment")))
    rest = [c for c in docs.columns if c not in ("text", "sections", "pages")]
    d = docs.where("text is not null").select(*rest, "pages", F.posexplode(F.when(F.size("sections") > 0, cut).otherwise(flat)).alias("sequence_index", "s"))
    text = F.when(F.col("s.section").isNull(), F.col("s.segment")).otherwise(F.concat(F.lit("["), F.col("s.section"), F.lit("] "), F.col("s.segment")))
    here = F.filter("pages", lambda p: (strip(p["text"]) != "") & (F.substring(strip(p["text"]), 1, 80) == F.substring("s.segment", 1, 80)))
    d = d.select(*rest, "sequence_index", text.alias("text"), F.col("s.section").alias("section"), F.get(F.reverse(here), F.lit(0))["page_number"].alias("page"))
    return d.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), F.col("text"))).withColumn("token_count", F.size(words(F.col("text"))))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section, level, heading, body) of the headings # to ######. Text before the first heading and sections without a body are dropped; only a line feed ends a line."""
    d = docs.where("text is not null").select(id_col, F.posexplode(F.split("text", "\n")).alias("line", "s"))
    head = F.regexp_extract("s", r"^(#{1,6})\s+(.+)$", 1)
    d = d.withColumn("level", F.length(head)).withColumn("heading", F.when(F.length(head) > 0, F.regexp_extract("s", r"^(#{1,6})\s+(.+)$", 2)))
    w = Window.partitionBy(id_col).orderBy("line")
    d = d.withColumn("sec", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w)).where("sec > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "s")))), lambda x: x["s"]), "\n")
    g = d.groupBy(id_col, "sec").agg(F.max("level").alias("level"), F.max("heading").alias("heading"), strip(body).alias("body"))
    return g.where("body <> ''").select(id_col, F.col("sec").alias("section"), "level", strip(F.col("heading")).alias("heading"), "body")


def plaintext_sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section, heading) of lines that look like headings; documents with fewer than two have none."""
    lines = F.split("text", "\n")
    d = docs.where("text is not null").select(id_col, F.posexplode(lines).alias("line", "s"), F.size(lines).alias("n"))
    w = Window.partitionBy(id_col).orderBy("line")
    t = strip(F.col("s"))
    d = d.withColumn("t", t).withColumn("prev", F.lag("t").over(w)).withColumn("next", F.lead("t").over(w)).withColumn("k", F.size(words(F.col("t"))))
    alone = (F.coalesce("prev", F.lit("")) == "") & (F.coalesce("next", F.lit("")) == "")
    short = (F.col("k") <= 10) & (F.length(F.coalesce("next", F.lit(""))) > 1.5 * F.length("t"))
    head = (F.col("t") != "") & (F.length("t") <= 120) & ~F.col("t").rlike("[.!?;,:'\"]$") & (F.col("k") <= 15) & (alone | short)
    h = d.where(head).select(id_col, "line", F.col("t").alias("heading"))
    n = h.groupBy(id_col).agg(F.count("*").alias("c")).where("c >= 2").select(id_col)
    return h.join(n, id_col, "left_semi")


def heading_paths(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section, path): headings joined by " > "; the stack is popped by its depth, and a heading of level 0 pops nothing."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "level", "heading")))
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<section:bigint,path:string>>").alias("out"))

    def push(a: Column, x: Column) -> Column:
        kept = F.when(x["level"] > 0, F.slice(a["stack"], F.lit(1), F.least(F.size(a["stack"]), F.greatest(F.lit(0), x["level"] - 1)))).otherwise(a["stack"])
        stack = F.concat(kept, F.array(x["heading"]))
        return F.struct(stack.alias("stack"), F.concat(a["out"], F.array(F.struct(x["section"].cast("bigint").alias("section"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    g = sections.groupBy(id_col).agg(ordered.alias("s"))
    return g.select(id_col, F.inline(F.aggregate("s", zero, push, lambda a: a["out"])))


def page_map(parsed: DataFrame) -> DataFrame:
    """(doc_id, head, page): the first 80 characters of each page; a later page overwrites."""
    p = parsed.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.substring(strip(F.col("p.text")), 1, 80).alias("head"), F.col("p.page_number").alias("page"))
    return p.where("head <> ''").groupBy("doc_id", "head").agg(F.max("page").alias("page"))
