"""Pages of a Notion workspace: listed by one search, fetched side by side, only those edited since they were last read."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

API, VERSION = "https://api.notion.com/v1", "2022-06-28"
MOST_PAGES, MOST_BLOCKS, MOST_CHARS, TIMEOUT = 1000, 5000, 20_000, 30.0

# What stands before and after the text of a block.
MARKS = {
    "heading_1": ("# ", ""),
    "heading_2": ("## ", ""),
    "heading_3": ("### ", ""),
    "bulleted_list_item": ("- ", ""),
    "numbered_list_item": ("1. ", ""),
    "code": ("```\n", "\n```"),
    "quote": ("> ", ""),
}


def _call(api: str, token: str, path: str, body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    headers = {"Authorization": f"Bearer {token}", "Notion-Version": VERSION, "Content-Type": "application/json"}
    request = urllib.request.Request(api + path, data=data, headers=headers, method="GET" if data is None else "POST")
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.loads(answer.read().decode("utf-8", errors="replace"))


def _walk(call, most: int) -> Iterator[dict]:
    """Results behind a cursor, ``most`` of them: ``call`` takes the cursor, None at first."""
    cursor, given = None, 0
    while given < most:
        answer = call(cursor)
        for result in answer.get("results", [])[: most - given]:
            given += 1
            yield result
        cursor = answer.get("next_cursor")
        if not answer.get("has_more") or not cursor:
            return


def _plain(parts) -> str:
    return "".join(p.get("plain_text", "") for p in parts or ()).strip()


def title_of(page: dict) -> str:
    titles = (_plain(p.get("title")) for p in page.get("properties", {}).values() if p.get("type") == "title" and p.get("title"))
    return next(titles, "(untitled)")


def block_text(block: dict) -> str:
    kind = block.get("type", "")
    text = _plain(block.get(kind, {}).get("rich_text"))
    before, after = MARKS.get(kind, ("", ""))
    return before + text + after if text else ""


def passage(title: str, edited: str, body: str, most: int = MOST_CHARS) -> str:
    """The text of a page under a line with its day and title; longer ones are cut, and say so."""
    whole = f"[notion {edited.split('T')[0]} {title}]\n\n{body}".strip()
    return whole if len(whole) <= most else whole[:most] + "\n\n[truncated]"


def pages(spark: SparkSession, token: str, api: str = API, page_size: int = 25, most: int = MOST_PAGES) -> DataFrame:
    """(id, title, edited) of the pages edited last, ``most`` of them: what one search gives the driver."""
    ask = {"filter": {"property": "object", "value": "page"}, "sort": {"direction": "descending", "timestamp": "last_edited_time"}, "page_size": page_size}
    found = _walk(lambda cursor: _call(api, token, "/search", ask | ({"start_cursor": cursor} if cursor else {})), most)
    rows = [(p.get("id", ""), title_of(p), p.get("last_edited_time") or "") for p in found]
    return spark.createDataFrame(rows, "id string, title string, edited string")


def pull(spark: SparkSession, token: str, marks: DataFrame | None = None, api: str = API, page_size: int = 25, tasks: int = 8) -> DataFrame:
    """(id, edited, text, error) of pages whose edit time is not in ``marks`` (id, edited); None reads them all.

    Each page's blocks are fetched where its row is.  A page that can't be read has an error and no text,
    so it belongs to no later ``marks`` and is tried again.
    """
    listed = pages(spark, token, api, page_size)
    due = listed if marks is None else listed.join(marks.select("id", "edited"), ["id", "edited"], "left_anti")

    def fetch(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = f"/blocks/{row['id']}/children?page_size=100"
                try:
                    blocks = _walk(lambda cursor, at=at: _call(api, token, at + (f"&start_cursor={cursor}" if cursor else "")), MOST_BLOCKS)
                    body = "\n\n".join(filter(None, map(block_text, blocks)))
                    out.append((row["id"], row["edited"], passage(row["title"], row["edited"], body), None))
                except (OSError, ValueError) as e:
                    out.append((row["id"], row["edited"], None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["id", "edited", "text", "error"])

    return due.repartition(tasks, "id").mapInArrow(fetch, "id string, edited string, text string, error string")


def marks_of(pulled: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, edited) to hand to the next ``pull``: the newest edit that was read of every page."""
    read = pulled.where("error is null").select("id", "edited")
    both = read if before is None else read.unionByName(before.select("id", "edited"))
    return both.groupBy("id").agg(F.max("edited").alias("edited"))
