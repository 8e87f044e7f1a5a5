"""Scalar text functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.functions import lexicon as L

#: Longest text that the statistics take; the cap is a feature of the model, not of a query.
TEXT_CAP = 32_768


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def strip(text: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def capped(text: Column, limit: int = TEXT_CAP) -> tuple[Column, Column]:
    """The text up to the cap, and whether it was longer."""
    return F.substring(text, 1, limit), F.length(text) > limit


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def normalised(text: Column) -> Column:
    """For duplicate checks: without a leading [timestamp] line, lower-cased, white space collapsed."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[[0-9]{4}-[0-9]{2}-[0-9]{2}T[^\]\n]*\][^\n]*\n", "")
    return F.trim(F.regexp_replace(F.lower(body), r"[ \t\n\x0b\f\r]+", " "))


def paragraphs(text: Column, least: int = 20) -> Column:
    """array<struct<position, chunk>> of blank-line separated paragraphs longer than ``least``; positions keep their gaps."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n[ \t\n\x0b\f\r]*\n", -1)
    placed = F.transform(parts, lambda x, i: F.struct(i.alias("position"), strip(x).alias("chunk")))
    return F.filter(placed, lambda x: F.length(x["chunk"]) > least)


def part_of_speech(word: Column) -> Column:
    """stop, aux, pron_self, pron_other, prep_rel, adv, verb, noun, adj or unknown, from word lists and suffixes."""
    w = F.lower(word)
    ends = lambda suffixes: w.rlike("(?:" + "|".join(suffixes) + ")$")
    long = F.length(w) > 4
    return (
        F.when(w.isin(L.GRAMMAR_STOPWORDS), "stop")
        .when(w.isin(L.AUXILIARIES), "aux")
        .when(w.isin(L.SELF_PRONOUNS), "pron_self")
        .when(w.isin(L.OTHER_PRONOUNS), "pron_other")
        .when(w.isin(L.RELATIONAL), "prep_rel")
        .when(F.endswith(w, F.lit("ly")) & (F.length(w) > 5), "adv")
        .when(long & ends(L.VERB_SUFFIXES), "verb")
        .when(long & ends(L.NOUN_SUFFIXES), "noun")
        .when(long & ends(L.ADJECTIVE_SUFFIXES), "adj")
        .otherwise("unknown")
    )


def structural(text: Column) -> Column:
    """array<double> of the eight dimensions' structural signals."""
    text = F.coalesce(text, F.lit(""))
    count = {k: F.regexp_count(text, F.lit(p)) for k, p in L.STRUCTURE.items()}
    sums = {d: F.lit(0.0) for d in L.DIMENSIONS}
    for dimension, names, weight, most in L.SIGNALS:
        n = sum((count[x] for x in names[1:]), count[names[0]])
        sums[dimension] = sums[dimension] + F.least(F.lit(most), n * F.lit(weight))
    return F.array(*sums.values())


def is_prose(text: Column) -> Column:
    """Whether the head of a text reads as prose: few brackets and quotes, mostly alphabetic words."""
    head = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\x0b\f\r]+", ""), 1, 200)
    words = F.filter(F.split(head, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    alpha = F.filter(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= F.length(w) * F.lit(0.6))
    few_marks = F.length(head) - F.length(F.translate(head, '{}[]":`=', "")) <= 8
    return (F.size(words) > 0) & few_marks & (F.size(alpha) >= F.size(words) * F.lit(0.6))


def snippet(text: Column, term: Column | str, before: int = 50, after: int = 200) -> Column:
    """From 50 characters before the first occurrence of the term to 200 after its start."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at + after - start)).otherwise(F.substring(text, 1, after))


def address(vector: Column) -> Column:
    """A+B_via_C from the up to three largest of eight dimensions above 0.01; ties in dimension order."""
    labels = F.array(*(F.lit(x.upper()) for x in L.LABELS))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  what is named several times is computed once

    def leading(v: Column) -> Column:
        ranked = F.transform(F.slice(v, 1, 8), lambda x, i: F.struct((-x).alias("low"), i.alias("place")))
        return F.slice(F.array_sort(F.filter(ranked, lambda x: x["low"] < -0.01)), 1, 3)

    def named(top: Column) -> Column:
        name = lambda k: F.element_at(labels, F.element_at(top, k)["place"] + 1)
        return (
            F.when(F.size(top) <= 0, "UNKNOWN")
            .when(F.size(top) == 1, name(1))
            .when(F.size(top) == 2, F.concat(name(1), F.lit("+"), name(2)))
            .otherwise(F.concat(name(1), F.lit("+"), name(2), F.lit("_via_"), name(3)))
        )

    return once(once(vector, leading), named)


def seed_vector(words: Column) -> Column:
    """Eight dimensions by the share of a passage's distinct words that are seed terms, largest 1."""
    hits = [F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) for terms in L.SEEDS.values()]
    most = F.greatest(*hits)
    return F.array(*(F.when(most > 0, h / most).otherwise(0.0) for h in hits))


def conservation(activation: Column) -> Column:
    """1 - a/sum of each activation; 1/n each if nothing is active."""
    total = F.aggregate(activation, F.lit(0.0), lambda s, x: s + x)
    return F.transform(activation, lambda a: F.when(total == 0, 1.0 / F.size(activation)).otherwise(1.0 - a / total))


def glyph(dominant: Column, chain: Column, text: Column) -> Column:
    """Dominant dimension and four hex digits of a hash of dimension, chain and head of text."""
    return F.concat(dominant, F.lit("."), F.substring(F.md5(F.concat_ws(":", dominant, F.array_join(chain, ">"), F.substring(text, 1, 200)).cast("binary")), 1, 4))


def deposit_score(user: Column, assistant: Column, markers=L.DOCTRINE, high_value=(), threshold: float = 1.5) -> tuple[Column, Column]:
    """(score, keep) of a turn pair: 2 for any marker, 1 per high-value word, half for a long answer."""
    both = F.concat(user, F.lit("\n\n"), assistant)
    marked = both.rlike("(?i)" + "|".join(markers))
    score = F.when(marked, 2.0).otherwise(0.0) + F.when(F.length(assistant) > 1000, 0.5).otherwise(0.0)
    for word in high_value:
        score = score + F.when(F.lower(both).contains(word.lower()), 1.0).otherwise(0.0)
    return score, score >= threshold


def routing_tag(user: Column, assistant: Column, tags: dict[str, list[str]], default: str = "ambient") -> Column:
    """The last tag one of whose patterns a turn pair matches."""
    both = F.concat(user, F.lit("\n\n"), assistant)
    out = F.lit(default)
    for tag, patterns in tags.items():
        out = F.when(both.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), tag).otherwise(out)
    return out


def modifiers(text: Column) -> dict[str, Column]:
    """depth, scope, focus, flex and urgent of a text, each at most 1; 0 without words.

    Words used three times are found by comparing the sorted words with themselves two places on,
    which is linear where counting each word would be quadratic.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    count = lambda keep: F.size(F.filter(words, keep)).cast("double")
    share = {k: count(_among(v)) / n for k, v in L.MODIFIERS.items()}
    commas = F.regexp_count(text, F.lit(","))
    middle = F.size(F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z]") & (F.length(w) > 1))).cast("double")
    capitals = count(lambda w: w.rlike("^[A-Z]{2,}$"))
    ordered = F.array_sort(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.lower(w)))
    m = F.size(ordered)
    ahead = F.slice(ordered, F.lit(3), F.greatest(m - 2, F.lit(0)))
    before = F.concat(F.array(F.lit("")), F.slice(ordered, F.lit(1), F.greatest(m - 3, F.lit(0))))
    here = F.slice(ordered, F.lit(1), F.greatest(m - 2, F.lit(0)))
    first = F.zip_with(F.zip_with(here, ahead, lambda a, b: F.when(a == b, a)), before, lambda a, b: a.isNotNull() & ~a.eqNullSafe(b))
    repeated = F.size(F.filter(first, lambda x: x)).cast("double")
    raw = {
        "depth": share["depth"] + F.least(n / 50, F.lit(0.5)),
        "scope": share["scope"] + F.least(commas / F.greatest(n / 5, F.lit(1.0)), F.lit(0.5)),
        "focus": share["focus"] + F.least(middle / n, F.lit(0.3)),
        "flex": share["flex"],
        "urgent": F.when(text.contains("!"), 0.3).otherwise(0.0) + F.least(capitals / n, F.lit(0.4)) + F.least(repeated * 0.15, F.lit(0.3)),
    }
    return {k: F.when(F.size(words) > 0, F.least(F.lit(1.0), v)).otherwise(0.0) for k, v in raw.items()}


def _among(words: list[str]):
    return lambda w: F.lower(w).isin(words)


def basin(vector: Column, chains: Column | None = None, least: float = 0.05) -> Column:
    """The basin of most weight, the first of equals; empty at ``least`` or below."""
    scores = []
    for weights, signs in L.BASINS.values():
        score = F.lit(0.0)
        for dimension, weight in weights.items():
            score = score + vector[L.DIMENSIONS.index(dimension)] * weight
        if chains is not None:
            for sign in signs:
                score = score + F.when(F.array_contains(chains, sign), 0.1).otherwise(0.0)
        scores.append(score)
    best = F.greatest(*scores)
    name = F.coalesce(*(F.when(s == best, n) for s, n in zip(scores, L.BASINS, strict=True)))
    return F.when(best > least, name).otherwise("")


def address_parts(address: Column) -> Column:
    """The dimension names of an address, in order."""
    return F.filter(F.transform(F.split(F.replace(address, F.lit("_via_"), F.lit("+")), r"\+"), lambda p: F.upper(F.trim(p))), lambda p: p != "")


def signature(steps: Column) -> Column:
    """DIM:op > DIM of an array of steps."""
    return F.array_join(steps, " > ")
