"""Readers: files to chunk rows (text, source, section, chunk_type, position).

Text-like formats are read by Spark and split with Column expressions; formats that need a
parser run it in an Arrow UDF over whole files.  Optional parsers that are not installed give
no rows for their files.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import text as X

BOUND = 4000
CODE = "py js ts go rs java c h cpp rb sh".split()
TEXT = "txt log rst tex org toml ini cfg conf env".split()
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "blockquote", "pre"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n# ")
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n")
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def strip_html(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.parts)).strip()


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles gone, blocks on lines of their own, headings marked."""

    @F.arrow_udf(T.StringType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array([strip_html(v.as_py()) for v in x], pa.string())

    return run(html)


def bound(piece: str, limit: int = BOUND, least: int = 20) -> list[str]:
    """Pieces of at most ``limit`` characters: cut at blank lines, lines, then sentences, and merged greedily."""
    pieces = [piece]
    for pattern in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+"):
        pieces = [q for p in pieces for q in (re.split(pattern, p) if len(p) > limit else [p])]
    merged: list[str] = []
    buffer = ""
    for p in filter(None, map(str.strip, pieces)):
        if buffer and len(buffer) + len(p) + 1 <= limit:
            buffer += " " + p
        else:
            if buffer:
                merged.append(buffer)
            buffer = p
    if buffer:
        merged.append(buffer)
    return [q for m in merged for q in (m[k : k + limit] for k in range(0, len(m), limit)) if len(q) > least]


def bounded_chunks(text: Column) -> Column:
    """array<string> of a text's paragraphs, none longer than the bound."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(x: pa.Array) -> pa.Array:
        cut = lambda t: [q for p in re.split(r"\n\s*\n", t or "") if len(p.strip()) > 20 for q in bound(p.strip())]
        return pa.array([cut(v.as_py()) for v in x], pa.list_(pa.string()))

    return run(text)


def _files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(source, text) of whole text files with a suffix, below a folder."""
    glob = "*.{" + ",".join(suffixes) + "}"
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def _chunks(files: DataFrame, pieces: Column, kind: str = "narrative", least: int = 20, section: Column | None = None) -> DataFrame:
    """Chunk rows of an array column; positions keep their gaps."""
    parts = files.select("source", F.posexplode(pieces).alias("position", "text"))
    text = X.strip(F.col("text"))
    return parts.select(text.alias("text"), "source", (F.lit("") if section is None else section).alias("section"), F.lit(kind).alias("chunk_type"), "position").where(F.length("text") > least)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Sections from heading to heading; a text without headings by paragraphs."""
    files = _files(spark, path, ["md", "markdown"])
    marked = F.col("text").rlike("(?m)^#")
    sections = F.split("text", "(?m)(?=^#)")
    pieces = F.when(marked, sections).otherwise(F.split("text", r"\n\s*\n"))
    heading = F.regexp_extract("text", r"^\s*#+\s*([^\n]*)", 1)
    return _chunks(files, pieces, section=heading)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return _chunks(_files(spark, path, TEXT), F.split("text", r"\n\s*\n"))


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """Pieces that start at a class or function definition."""
    return _chunks(_files(spark, path, CODE), F.split("text", r"(?m)(?=^(?:class |def |async def ))"), "code", 30)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("text", "<[^>]+>", " "), r"\s+", " ")
    return _chunks(_files(spark, path, ["xml"]), F.array(plain))


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("text", r"\\[a-z]+-?\d*\s?", ""), r"[{}]", "")
    return _chunks(_files(spark, path, ["rtf"]), F.split(plain, r"\n\s*\n"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    files = _files(spark, path, ["html", "htm"])
    return _chunks(files, F.split(html_text(F.col("text")), r"\n\s*\n"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A chunk per record."""
    files = _files(spark, path, ["jsonl", "ndjson"])
    return _chunks(files, F.split("text", "\n"), "data", section=F.concat(F.lit("record_"), F.col("position").cast("string")))


def _whole(spark: SparkSession, path: str, suffixes: list[str], parse) -> DataFrame:
    @F.arrow_udf(T.StringType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array([parse(v.as_py()) for v in x], pa.string())

    return _chunks(_files(spark, path, suffixes).withColumn("text", run("text")), F.array("text"), "data", 0)


def pretty_json(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, ["json"], pretty_json)


def pretty_yaml(text: str) -> str:
    try:
        import yaml

        return json.dumps(yaml.safe_load(text), indent=2, ensure_ascii=False, default=str)
    except Exception:  # noqa: BLE001  no parser, or no YAML
        return text


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, ["yaml", "yml"], pretty_yaml)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A summary chunk per file, then ``column: value`` lines per row."""
    files = _files(spark, path, ["csv", "tsv"])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(source: pa.Array, text: pa.Array) -> pa.Array:
        import csv

        out = []
        for s, t in zip(source.to_pylist(), text.to_pylist(), strict=True):
            rows = list(csv.reader(io.StringIO(t), delimiter="\t" if s.endswith(".tsv") else ","))
            if not rows:
                out.append([])
                continue
            head = f"CSV: {s.rsplit('/', 1)[-1]}\nColumns: {', '.join(rows[0])}\nRows: {len(rows) - 1}"
            lines = ["\n".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=True)) if len(r) == len(rows[0]) else ", ".join(r) for r in rows[1:]]
            out.append([head, *lines])
        return pa.array(out, pa.list_(pa.string()))

    return _chunks(files, run("source", "text"), "data")


def docx_sections(data: bytes) -> list[str]:
    """Sections of a word-processor file, split at heading paragraphs."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return []
    sections: list[list[str]] = [[]]
    for p in root.iter(w + "p"):
        text = "".join(t.text or "" for t in p.iter(w + "t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        if style is not None and style.get(w + "val", "").startswith("Heading") and sections[-1]:
            sections.append([])
        if text.strip():
            sections[-1].append(text)
    return ["\n".join(s) for s in sections]


def pptx_slides(data: bytes) -> list[str]:
    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return []
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return ["\n".join(t.text or "" for t in ElementTree.fromstring(z.read(n)).iter(a + "t")) for n in names]


def pdf_pages(data: bytes) -> list[str]:
    try:
        import fitz
    except ImportError:
        return []
    with fitz.open(stream=data, filetype="pdf") as pages:
        return [page.get_text() for page in pages]


def _binary(spark: SparkSession, path: str, suffix: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(x: pa.Array) -> pa.Array:
        return pa.array([parse(v.as_py()) for v in x], pa.list_(pa.string()))

    return _chunks(files.select(F.col("path").alias("source"), "content"), run("content"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "docx", docx_sections)


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "pptx", pptx_slides)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "pdf", pdf_pages)


READERS = {
    "markdown": read_markdown, "text": read_text, "code": read_code, "xml": read_xml, "rtf": read_rtf, "html": read_html, "jsonl": read_jsonl,
    "json": read_json, "yaml": read_yaml, "csv": read_csv, "docx": read_docx, "pptx": read_pptx, "pdf": read_pdf,
}


def read_folder(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Chunks of every readable file below a folder; other suffixes are passed over."""
    parts = [READERS[k](spark, path) for k in kinds or READERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def absorb(records: DataFrame, least: int = 10) -> DataFrame:
    """(text) of JSON records under any of the usual keys."""
    keys = [k for k in ("text", "page_content", "content", "preview") if k in records.columns]
    text = F.coalesce(*(F.col(k).cast("string") for k in keys)) if keys else F.lit(None).cast("string")
    return records.select(text.alias("text")).where(F.length(X.strip(F.col("text"))) >= least)


def discover(spark: SparkSession, path: str, least: int = 50, most: int = 1_000_000) -> DataFrame:
    """(path, modificationTime, length) of files of a sensible size, oldest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.where((F.col("length") >= least) & (F.col("length") <= most)).orderBy("modificationTime", "path")
