"""Texts taken over from other stores: JSON lines, the documents beside a vector index, paged HTTP endpoints."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skarn.functions import text as X

# Keys that answers hold their items under, and items their text under, in order of preference.
ITEM_KEYS = ("results", "documents", "data")
TEXT_KEYS = ("text", "preview", "content", "page_content")
LEAST = 10


def items_of(answer) -> list | None:
    """The items of an answer: a list, or what stands under the first of the usual keys; None for anything else."""
    if isinstance(answer, dict):
        answer = next((answer[k] for k in ITEM_KEYS if k in answer), [])
    return answer if isinstance(answer, list) else None


def text_of(item) -> str | None:
    """The text of an item that is longer than LEAST without the blanks around it."""
    if isinstance(item, dict):
        item = next((item[k] for k in TEXT_KEYS if k in item), None)
    elif not isinstance(item, str):
        return None
    found = "" if item is None else str(item)
    return found if len(found.strip()) > LEAST else None


class HttpPages(DataSource):
    """``spark.read.format("http_pages").option("url", ...)``: (page, text) of an endpoint that answers in pages.

    Options: pages (50 at most), size (items of a full page, 100), timeout (seconds, 30).  An answer
    with fewer items is the last.  A first page that fails is an error; a later one ends the reading.
    Whether a next page exists is known only from the one before, so one task reads, page by page.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.pages, self.size = int(options.get("pages", "50")), int(options.get("size", "100"))
        self.timeout = float(options.get("timeout", "30"))

    def _page(self, number: int):
        joint = "&" if "?" in self.url else "?"
        url = self.url if number == 0 else f"{self.url}{joint}page={number}&limit={self.size}"
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            return json.loads(answer.read().decode("utf-8"))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number in range(self.pages):
            try:
                found = items_of(self._page(number))
            except (OSError, ValueError):
                if number == 0:
                    raise
                return
            for item in found or ():
                text = text_of(item)
                if text is not None:
                    yield number, text
            if len(found or ()) < self.size:
                return


def from_http(spark: SparkSession, url: str, **options) -> DataFrame:
    """(text, source) of a paged endpoint."""
    spark.dataSource.register(HttpPages)
    pages = spark.read.format("http_pages").options(url=url, **{k: str(v) for k, v in options.items()}).load()
    return pages.select("text", F.lit(f"absorb:{url.split('/')[-1]}").alias("source"))


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, source) of JSON lines; lines that are no JSON or hold no text are left out.  One scan, no inference."""
    rows = spark.read.schema(", ".join(f"{k} string" for k in ("text", "source"))).json(path)
    own = F.coalesce("source", F.lit(f"absorb:{path.rstrip('/').split('/')[-1]}"))
    return rows.where(F.length(X.strip(F.col("text"))) >= LEAST).select("text", own.alias("source"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sidecar(spark: SparkSession, path: str) -> str:
    """The file that holds the documents of a vector index, of the usual names beside it."""
    folder, _, name = path.rpartition("/")
    stem = name.rpartition(".")[0] or name
    for candidate in (f"{stem}.jsonl", f"{stem}_metadata.json", f"{stem}_docstore.jsonl", "docstore.json", "metadata.jsonl"):
        found = f"{folder}/{candidate}" if folder else candidate
        if _exists(spark, found):
            return found
    raise FileNotFoundError(f"no documents beside {path}")


def from_index(spark: SparkSession, path: str) -> DataFrame:
    """(text, source) of the documents beside a vector index: JSON lines, or one JSON list or map of texts or objects."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    store = sidecar(spark, path)
    if store.endswith(".jsonl"):
        return from_jsonl(spark, store)
    whole = spark.read.text(store, wholetext=True)
    listed, mapped = F.from_json("value", "array<string>"), F.map_values(F.from_json("value", "map<string,string>"))
    is_list = F.ltrim("value").startswith("[")
    items = whole.select(F.explode(F.when(is_list, listed).otherwise(mapped)).alias("item"))
    text = F.coalesce(*(F.get_json_object("item", f"$.{k}") for k in ("text", "page_content")), "item")
    rows = items.select(text.alias("text")).where(F.length(X.strip(F.col("text"))) > LEAST)
    return rows.withColumn("source", F.lit(f"absorb:{store.split('/')[-1]}"))


def absorb(spark: SparkSession, source: str) -> DataFrame:
    """(text, source) of a source by its prefix (http:, https:, jsonl:, faiss:), else by its suffix, else as JSON lines."""
    if source.startswith(("http://", "https://")):
        return from_http(spark, source)
    prefix, _, rest = source.partition(":")
    if prefix == "jsonl":
        return from_jsonl(spark, rest)
    if prefix == "faiss" or source.endswith((".faiss", ".index")):
        return from_index(spark, rest if prefix == "faiss" else source)
    if _exists(spark, source):
        return from_jsonl(spark, source)
    raise ValueError(f"unknown source: {source}")
