"""Files: listing, reading and parsing, and the table store."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARSED = "filename string, text string, pages array<struct<page_number:int,text:string>>, sections array<struct<heading:string,text:string,level:int>>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFileType(ValueError):
    """No parser for the file."""


def list_files(listing: DataFrame, types: tuple[str, ...], max_mb: float) -> DataFrame:
    """Files of the allowed types within the size limit; an unknown size passes."""
    size = F.col("size").cast("bigint")
    return listing.where(F.col("mime").isin(*types) & (size.isNull() | (size <= int(max_mb * 1024 * 1024))))


def read_folder(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modified, size, content) of all files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def _markdown(text: str) -> list[dict]:
    heads = list(re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M))
    ends = [h.start() for h in heads[1:]] + [len(text)]
    out = [{"heading": h.group(2).strip(), "text": text[h.end() : e].strip(), "level": len(h.group(1))} for h, e in zip(heads, ends)]
    return [s for s in out if s["text"]]


def _plain(text: str) -> list[dict]:
    """Sections of a text without marks: lines that look like headings begin one; fewer than two are none."""
    lines = text.split("\n")
    t = [x.strip() for x in lines]
    at = []
    for i, x in enumerate(t):
        before, after, n = t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else "", len(x.split())
        if x and len(x) <= 120 and x[-1] not in ".!?;,:'\"" and n <= 15 and (not before and not after or n <= 10 and len(after) > 1.5 * len(x)):
            at.append(i)
    if len(at) < 2:
        return []
    out = [{"heading": t[i], "text": "\n".join(lines[i + 1 : j]).strip(), "level": 1} for i, j in zip(at, [*at[1:], len(t)])]
    return [s for s in out if s["text"]]


def parse_docx(content: bytes) -> tuple[str, list[dict]]:
    """Text and sections of a word-processor file; only the standard library is needed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras, sections = [], []
    for p in root.iter(f"{_W}p"):
        t = "".join(x.text or "" for x in p.iter(f"{_W}t")).strip()
        if not t:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        paras.append(t)
        if name.lower().replace(" ", "").startswith("heading"):
            n = re.search(r"(\d+)$", name)
            sections.append({"heading": t, "text": "", "level": int(n.group(1)) if n else 1})
        elif sections:
            s = sections[-1]
            s["text"] = f"{s['text']}\n{t}" if s["text"] else t
    return "\n\n".join(paras), [s for s in sections if s["text"]]


def pdf_headings(spans: list[tuple[float, str]]) -> list[tuple[str, int]]:
    """(heading, level) of lines larger than the body size, which is the size with most characters."""
    n: dict[float, int] = {}
    for size, t in spans:
        n[size] = n.get(size, 0) + len(t)
    if not n:
        return []
    body = max(n, key=lambda s: n[s])  # the first seen on a tie
    level = lambda s: 1 if s > body + 4 else 2 if s > body + 2 else 3
    return [(t.strip(), level(s)) for s, t in spans if s > body + 0.5 and len(t) < 200 and t.strip()]


def pdf_sections(spans: list[tuple[float, str]], text: str) -> list[dict]:
    """Sections of a PDF's lines with their sizes: the body is the text up to where the next heading is found."""
    heads, out = pdf_headings(spans), []
    for i, (h, level) in enumerate(heads):
        if (at := text.find(h)) < 0:
            continue
        at += len(h)
        end = text.find(heads[i + 1][0], at) if i + 1 < len(heads) else -1
        if body := (text[at:end] if end > at else text[at:]).strip():
            out.append({"heading": h, "text": body, "level": level})
    return out


def _pdf_lines(doc) -> list[tuple[float, str]]:
    """(largest size, text) of each line with text."""
    out = []
    for line in (x for p in doc for b in p.get_text("dict").get("blocks", []) for x in b.get("lines", [])):
        t = "".join(s.get("text", "") for s in line.get("spans", [])).strip()
        sizes = [s["size"] for s in line.get("spans", []) if s.get("text", "").strip()]
        if t and sizes:
            out.append((max(sizes), t))
    return out


#: Parsers by the ending of a file's name.
PARSERS = {"pdf": "pdf", "docx": "docx", "md": "text", "markdown": "text", "txt": "text", "": "text"}


def parser_of(name: Column) -> Column:
    """pdf, docx, text or unsupported, by the name's ending; a name without one is text."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), ext), F.lit("unsupported"))


def parse_bytes(filename: str, content: bytes) -> dict:
    ext = filename.rsplit(".", 1)[-1].lower() if "." in filename else ""
    pages: list[dict] = []
    if ext == "docx":
        text, sections = parse_docx(content)
    elif ext == "pdf":
        try:
            import fitz
        except ImportError as e:
            raise UnsupportedFileType("PDF files need an optional library") from e
        doc = fitz.open(stream=content, filetype="pdf")
        pages = [{"page_number": i + 1, "text": p.get_text()} for i, p in enumerate(doc)]
        text = "\n\n".join(p["text"] for p in pages)
        sections = pdf_sections(_pdf_lines(doc), text)
    elif PARSERS.get(ext) == "text":
        text = content.decode("utf-8", "replace")
        sections = _markdown(text) or _plain(text)
    else:
        raise UnsupportedFileType(filename)
    return {"filename": filename, "text": text, "pages": pages, "sections": sections, "error": None}


def parse_files(files: DataFrame) -> DataFrame:
    """Parsed documents of (path, content); a file that cannot be read has an error and no text."""

    def run(it):
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    out.append(parse_bytes(name, bytes(content)))
                except Exception as e:
                    out.append({"filename": name, "text": None, "pages": [], "sections": [], "error": str(e)[:500]})
            yield pd.DataFrame(out, columns=["filename", "text", "pages", "sections", "error"])

    return files.select("path", "content").mapInPandas(run, PARSED)


class TableStore:
    """Parquet tables below a folder, partitioned by namespace; a write goes to a new folder that replaces the old one when it is complete."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._fs(f"{self.root}/{name}")
        return fs.exists(p)

    def read(self, name: str, namespace: str | None = None) -> DataFrame:
        p, fs = self._fs(f"{self.root}/_{name}.schema")
        r = self.spark.read.option("mergeSchema", True)
        if fs.exists(p):  # a table without rows has no files that tell its columns
            f = fs.open(p)
            r = r.schema(StructType.fromJson(json.loads(bytes(f.readAllBytes()).decode())))
            f.close()
        df = r.parquet(f"{self.root}/{name}")
        return df if namespace is None else df.where(F.col("namespace") == namespace)

    def _keep_schema(self, name: str, df: DataFrame) -> None:
        p, fs = self._fs(f"{self.root}/_{name}.schema")
        f = fs.create(p, True)
        f.write(bytearray(df.schema.json().encode()))
        f.close()

    def replace(self, name: str, df: DataFrame) -> None:
        new, fs = self._fs(f"{self.root}/_{name}.new")
        fs.delete(new, True)
        w = df.write
        (w.partitionBy("namespace") if "namespace" in df.columns else w).parquet(f"{self.root}/_{name}.new")
        old, _ = self._fs(f"{self.root}/{name}")
        gone, _ = self._fs(f"{self.root}/_{name}.old")
        fs.delete(gone, True)
        if fs.exists(old):
            fs.rename(old, gone)
        fs.rename(new, old)
        fs.delete(gone, True)
        self._keep_schema(name, df)

    def replace_namespaces(self, name: str, df: DataFrame, namespaces: list[str]) -> None:
        """The rows of some namespaces anew; the folders of the others are not touched. ``df`` must not read the same table."""
        if not self.exists(name):
            self.replace(name, df)
            return
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(f"{self.root}/{name}")
        left = {r.namespace for r in df.select("namespace").distinct().collect()}
        for n in set(namespaces) - left:
            self.drop_namespace(n, [name])

    def append(self, name: str, df: DataFrame) -> None:
        if not self.exists(name):
            self._keep_schema(name, df)
        w = df.write.mode("append")
        (w.partitionBy("namespace") if "namespace" in df.columns else w).parquet(f"{self.root}/{name}")

    def drop_namespace(self, namespace: str, names: list[str]) -> None:
        for n in names:
            p, fs = self._fs(f"{self.root}/{n}/namespace={namespace}")
            fs.delete(p, True)
