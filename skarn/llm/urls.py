"""URL filters with redirect equivalence.

A rule names a host (and all its subdomains) and a path prefix; the longest rule that fits
decides.  Pages that no rule fits may be aliases: canonical links and redirects found in pages
are edges between URLs, and every class of connected URLs, crawled or only linked, gets a
decision: allow if a member is explicitly allowed, else block if a member is blocked.

All canonical links and refresh redirects of a page count.  Targets are made absolute against the
page's url, ``./`` and ``../`` are resolved, the ports 80 and 443 are left out.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, no alias,
and is allowed; URLs that differ only in scheme, default port or fragment are one; a null html has
no edges; html and urls of any length are read whole; repeated rows each give a row; rows without a
url are dealt by id; an empty table gives no rows; further columns are left out, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?([^"'\s>;]+)"""


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and query of a url."""
    url = F.coalesce(url, F.lit(""))
    host, path, query = (F.regexp_extract(url, _PARTS, k) for k in (1, 2, 3))
    return F.translate(host, UPPER, LOWER), path, query


def decide(host: Column, path: Column, rules=RULES) -> Column:
    """struct<size, allow, rule> of the longest rule that fits, allow first among equals; else null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def _resolved(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments, read from its end: a ``..`` skips the next that stays."""
    kind = "struct<skip:int,tail:string>"
    state = lambda skip, tail: F.struct(skip.alias("skip"), tail.alias("tail")).cast(kind)
    step = lambda acc, x: (
        F.when(x == ".", acc).when(x == "..", state(acc["skip"] + 1, acc["tail"])).when(acc["skip"] > 0, state(acc["skip"] - 1, acc["tail"])).otherwise(state(acc["skip"], F.concat(F.lit("/"), x, acc["tail"])))
    )
    first = state(F.lit(0), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))
    segments = F.reverse(F.split(F.substring(path, F.lit(2), F.length(path)), "/"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.aggregate(segments, first, step, lambda acc: acc["tail"])).otherwise(path)


def _node(url: Column) -> Column:
    host, path, query = parts(url)
    host = F.regexp_replace(host, r":(80|443)?$", "")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(_resolved(path)), query))


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of canonical links and redirects, targets made absolute."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, _HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, _TARGET, 1))
    found = pages.select(url.alias("url"), F.explode(F.concat(canonical, refresh)).alias("raw")).where("raw <> ''")
    raw = F.replace(F.col("raw"), F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    own, folder = F.regexp_extract("url", r"(?s)^([^?#]*)", 1), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    target = (
        F.when(raw.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(site, raw))
        .when(raw.startswith("?"), F.concat(own, raw))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), raw))
    )
    return found.select("url", target.alias("target"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, alias_of (the least URL of the class, null outside classes)."""
    host, path, _ = parts(F.col(url_col))
    judged = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), _node(F.col(url_col)).alias("node"), decide(host, path, rules).alias("d")
    )
    links = edges(pages, url_col, html_col)
    ends = links.select(_node(F.col("url")).alias("src"), _node(F.col("target")).alias("dst")).where("src <> dst")
    classes = connected_components(ends)
    node_host = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    node_path = F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    known = classes.withColumn("allow", decide(node_host, node_path, rules)["allow"])
    of_class = known.groupBy("component").agg(F.max("allow").alias("allowed"), F.min("allow").alias("none_blocked"))
    decided = known.select("node", "component").join(of_class, "component").select("node", F.col("component").alias("alias_of"), "allowed", "none_blocked")
    spread = F.concat(F.lit("\0"), F.xxhash64("id").cast("string"))  # no node is like it, so rows without one stay apart
    joined = judged.withColumn("node", F.coalesce("node", spread)).join(decided, "node", "left")
    alias = F.when(F.coalesce("allowed", F.lit(True)) | F.coalesce("none_blocked", F.lit(True)), "allow").otherwise("block")
    verdict = F.when(F.col("d").isNull(), alias).when(F.col("d.allow"), "allow").otherwise("block")
    return joined.select("id", "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"), "alias_of")
