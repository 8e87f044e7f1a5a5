"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's pattern gives a Boolean trigram query (``trigrams.query``).  The index posts
(trigram, document) for the trigrams that some query names; alternatives of a query intersect
postings by counting, the clauses of a rule intersect again, and what is left is verified with
the pattern on the whole text.  A rule without a mandatory trigram (long hex) scans every text.
Postings and candidates are keyed by a hash of id and text, so neither a trigram that every text
holds nor rows without an id make a hot group.  A hash that two documents share, or rows that
repeat, can only add candidates, which verification drops.

Only texts that hold an alternative of some rule's first clause are moved to meet the index's
candidates; all others are scanned where they are read.

Positions come from the lengths of the gaps and matches of a rule, added up in blocks of about
the square root of their number, so a text with very many matches costs little more than a long one.

Defined results: a null text is empty and has no spans; repeated rows and rows without an id each
give a row; an empty table gives no rows; a column of the input with the result's name is replaced, other
names never clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm import trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, and the least length of a group of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    long: str | None = None  # the same long matches, without the short ones


def _long(pattern: str, least: int) -> str:
    """A pattern X+ whose matches never overlap, with at least so many X."""
    return f"{pattern[:-1]}{{{least},}}"


_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = Rule("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6)
#: Of a run of [A-Z0-9] the first AKIA has the longest match, so if that is short all are; a hex run is matched whole.
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20, _long(r"AKIA[A-Z0-9]+", 16))
HEX = Rule("hex", r"[0-9a-f]+", 0, 24, _long(r"[0-9a-f]+", 24))
BASE = (ASSIGN, ACCESS, HEX)
#: Further kinds with published, fixed formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def document_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(3), docs[id_col], docs[text_col])


def _queries(rules: tuple[Rule, ...]) -> tuple[dict[int, list[trigrams.Clause]], list[str]]:
    """The queries of the rules that have one, and the trigrams that they name."""
    queries = {k: q for k, rule in enumerate(rules) if (q := trigrams.query(rule.pattern))}
    return queries, sorted({g for q in queries.values() for clause in q for alternative in clause for g in alternative})


def postings(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, doc): which documents hold which of the named trigrams; gram is the index into ``names``."""
    low = docs.select(document_key(docs, id_col, text_col).alias("doc"), F.lower(F.coalesce(docs[text_col], F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(k)) for k, g in enumerate(names))))
    return low.select("doc", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rules): the rules, by index, that a document may match; rules without trigrams are left out."""
    spark = docs.sparkSession
    queries, names = _queries(rules)
    terms = [
        (names.index(g), k, c, a, len(alternative))
        for k, q in queries.items()
        for c, clause in enumerate(q)
        for a, alternative in enumerate(sorted(clause, key=sorted))
        for g in sorted(alternative)
    ]
    needs = spark.createDataFrame([(k, len(q)) for k, q in queries.items()], "rule int, clauses int")
    wanted = spark.createDataFrame(terms, "gram int, rule int, clause int, alternative int, need int")  # a few hundred rows, from the rules alone
    alternatives = (
        postings(docs, names, id_col, text_col)
        .join(F.broadcast(wanted), "gram")
        .groupBy("doc", "rule", "clause", "alternative")
        .agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        .where("n >= need")
    )
    clauses = alternatives.groupBy("doc", "rule").agg(F.count_distinct("clause").alias("held"))
    passed = clauses.join(F.broadcast(needs), "rule").where("held = clauses")
    return passed.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def promising(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text holds an alternative of some rule's first clause; what no document without it can match."""
    every = sorted({a for q in _queries(rules)[0].values() for a in q[0]}, key=sorted)
    holds = lambda low: reduce(Column.__or__, (reduce(Column.__and__, (low.contains(g) for g in sorted(a))) for a in every), F.lit(False))
    return F.exists(F.array(F.lower(text)), holds)  # lower-cased once for all trigrams


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPAN = "struct<start:int,order:int,end:int,kind:string,size:int>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind, size>> of the rule's matches that are long enough; code points."""
    form = rule.long or rule.pattern
    pattern = F.lit(form)
    gaps, hits = F.split(text, form, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    pieces = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))),
        sized,
        lambda p, s: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), F.length(s).alias("size")),
    )
    state = f"struct<at:int,found:array<{SPAN}>>"
    start = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("found")).cast(state)
    span = lambda at, p: F.struct(
        (at + p["gap"]).alias("start"), F.lit(order).alias("order"), (at + p["gap"] + p["hit"]).alias("end"), F.lit(rule.kind).alias("kind"), p["size"].alias("size")
    ).cast(SPAN)
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["hit"]).alias("at"), F.concat(acc["found"], F.when(p["size"] >= rule.least, F.array(span(acc["at"], p))).otherwise(F.array().cast(f"array<{SPAN}>"))).alias("found")
    ).cast(state)
    walk = lambda block, at: F.aggregate(block, start(at), step, lambda acc: acc["found"])
    chars = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["hit"])

    def found(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(own), size), lambda k: F.slice(own, k, size))
        return _bound(blocks, placed)

    def placed(blocks: Column) -> Column:
        offsets = F.aggregate(F.transform(blocks, chars), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), walk))

    return _bound(pieces, lambda own: F.when(F.size(own) > 0, found(own)).otherwise(F.array().cast(f"array<{SPAN}>")))


def _verified(text: Column, may: Column | None, rules: tuple[Rule, ...]) -> Column:
    """All spans, of indexed rules only where ``may`` (an array of rules) says so; no ``may``: of the other rules alone."""
    empty = F.array().cast(f"array<{SPAN}>")
    every = []
    for k, rule in enumerate(rules):
        matched = text.rlike(rule.long or rule.pattern)
        if not trigrams.query(rule.pattern):
            every.append(F.when(matched, spans(text, rule, k)).otherwise(empty))
        elif may is not None:
            every.append(F.when(F.coalesce(F.array_contains(may, k), F.lit(False)) & matched, spans(text, rule, k)).otherwise(empty))  # null AND x would still run x
    return F.array_sort(F.concat(empty, *every))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with column ``out``: the spans, sorted by start and rule."""
    found = candidates(docs, rules, id_col, text_col).select(F.col("doc").alias("of_doc"), "rules")
    kept = F.struct(*(docs[c] for c in docs.columns if c.lower() != out.lower()))
    whole = docs.select(kept.alias("row"), document_key(docs, id_col, text_col).alias("doc"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    near = promising(text, rules)
    joined = whole.where(near).join(found.hint("shuffle_hash"), F.col("doc") == F.col("of_doc"), "left")
    moved = joined.select("row.*", _verified(text, F.col("rules"), rules).alias(out))
    return moved.unionByName(whole.where(~near).select("row.*", _verified(text, None, rules).alias(out)))


def digest(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with every span of a sorted, non-empty array replaced by <SECRET>, overlapping ones as one.

    Spans are worked off in blocks; a block's part of the text is cut out once.
    """
    kind = "struct<at:int,text:string>"

    def step(acc: Column, s: Column, part: Column, base: Column) -> Column:
        start, end = s["start"] - base, s["end"] - base
        before = F.when(start >= acc["at"], F.concat(F.substring(part, acc["at"] + 1, start - acc["at"]), F.lit("<SECRET>"))).otherwise(F.lit(""))
        return F.when(end <= acc["at"], acc).otherwise(F.struct(end.alias("at"), F.concat(acc["text"], before).alias("text")).cast(kind))

    def cleaned(block: Column, base: Column, top: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text")).cast(kind)
        return _bound(F.substring(text, base + 1, top - base), lambda part: F.aggregate(block, first, lambda acc, s: step(acc, s, part, base), lambda acc: acc["text"]))

    def joined(blocks: Column, tops: Column) -> Column:
        parts = F.transform(blocks, lambda block, k: cleaned(block, F.get(tops, k), F.get(tops, k + 1)))
        last = F.element_at(tops, -1)
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    def split(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(own), size), lambda k: F.slice(own, k, size))

    def tops(blocks: Column) -> Column:
        most = lambda acc, block: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(F.transform(block, lambda s: s["end"])))))
        return F.aggregate(blocks, F.array(F.lit(0)), most)

    return _bound(found, lambda own: _bound(split(own), lambda blocks: _bound(tops(blocks), lambda ends: joined(blocks, ends))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by <SECRET>; overlapping secrets are replaced as one."""
    out = "secret_spans"
    while out in map(str.lower, docs.columns):
        out += "_"
    scanned = scan(docs, rules, id_col, text_col, out)
    text = F.col(text_col)
    return scanned.withColumn(text_col, F.when(F.size(out) > 0, masked(text, F.col(out))).otherwise(text)).drop(out)
