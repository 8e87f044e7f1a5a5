"""The grammar parse: words scored on eight dimensions by lexicon, word class and neighbours.

The lexicon is a parameter: exemplar words by dimension and class (verbs 1.0, connectors 0.7,
markers 0.5) and operation verbs.  By default the seed terms stand in as exemplars.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions import lexicon as L

DOMINANT = 0.3
_WORDS = re.compile("[a-zA-Z]+")


@dataclass(frozen=True)
class Lexicon:
    """exemplars: word -> {dimension: score}; operations: verb -> (dimension, operation)."""

    exemplars: dict[str, dict[str, float]] = field(default_factory=lambda: {w: {d: 1.0} for d, terms in L.SEEDS.items() for w in terms})
    operations: dict[str, tuple[str, str]] = field(default_factory=dict)

    def stem(self, word: str) -> str:
        """A known form of the word without ing, ed, es, s or ly; the word itself if there is none."""
        if len(word) <= 4:
            return word
        known = lambda w: w in self.exemplars or w in self.operations
        for suffix in ("ing", "ed", "es", "s", "ly"):
            if word.endswith(suffix):
                root = word[: -len(suffix)]
                for form in (root, root + "e", root[:-1] if len(root) > 2 and root[-1:] == root[-2:-1] else root):
                    if known(form):
                        return form
        return word


def word_class(word: str) -> str:
    """The part of speech that word lists and suffixes suggest."""
    for name, words in _CLASSES:
        if word in words:
            return name
    if len(word) > 5 and word.endswith("ly"):
        return "adv"
    if len(word) > 4:
        for name, suffixes in (("verb", L.VERB_SUFFIXES), ("noun", L.NOUN_SUFFIXES), ("adj", L.ADJECTIVE_SUFFIXES)):
            if word.endswith(suffixes):
                return name
    return "unknown"


_CLASSES = [
    (name, frozenset(words))
    for name, words in (("stop", L.GRAMMAR_STOPWORDS), ("aux", L.AUXILIARIES), ("pron_self", L.SELF_PRONOUNS), ("pron_other", L.OTHER_PRONOUNS), ("prep_rel", L.RELATIONAL))
]


# What a word of a class without an exemplar stands for.
CLASS_SCORES = {
    "pron_self": {"IC": 0.3, "AI": 0.3},
    "pron_other": {"CR": 0.4},
    "prep_rel": {"CR": 0.6},
    "adv": {"IC": 0.1},
    "adj": {"IC": 0.1},
}
# What an unknown verb stands for after a relational word, after a self pronoun, and else.
VERB_SCORES = ((frozenset(L.RELATIONAL), {"CR": 0.4}), (frozenset(L.SELF_PRONOUNS), {"IC": 0.3, "AI": 0.2}))
VERB_DEFAULT = {"EW": 0.3}
#: Neighbours (one before, one after) that lend a class their exemplar dimensions, and how much of each.
LENDERS = {"noun": (0, 1), "adj": (1,)}
LENT, PROPAGATED, WEAK = 0.3, 0.5, 0.3


def _by_class(kind: str, near: tuple[str, str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """(dimension, score) that a word's class and its neighbours suggest."""
    found = list(CLASS_SCORES.get(kind, {}).items())
    if kind == "verb":
        found = [x for words, scores in VERB_SCORES if near[0] in words for x in scores.items()] or list(VERB_DEFAULT.items())
    for k in LENDERS.get(kind, ()):
        found += [(d, LENT) for d in lexicon.exemplars.get(lexicon.stem(near[k]), {})]
    return found


def word_scores(word: str, kind: str, before: str, after: str, lexicon: Lexicon, context: dict[str, dict[str, float]] | None = None) -> tuple[dict[str, float], tuple[str, str] | None]:
    """A word's dimensions, and its operation if it names one.

    Operation and exemplar lead; without either the word class and the neighbours decide; what is
    weak then is helped by ``context``, the dimensions of the exemplars that the word occurs with.
    """
    stem = lexicon.stem(word)
    operation = lexicon.operations.get(word) or lexicon.operations.get(stem)
    found = [(operation[0], 1.0)] if operation else []
    found += (lexicon.exemplars.get(word) or lexicon.exemplars.get(stem) or {}).items()
    found = found or _by_class(kind, (before, after), lexicon)
    scores: dict[str, float] = {}
    for d, x in found:
        scores[d] = scores.get(d, 0.0) + x
    if context and sum(scores.values()) < WEAK:
        for d, x in context.get(word, {}).items():
            scores[d] = scores.get(d, 0.0) + PROPAGATED * x
    return scores, operation


def parse(text: str | None, lexicon: Lexicon, context: dict[str, dict[str, float]] | None = None) -> dict:
    """Eight mean scores (at most 1), distinct chains of dominant dimensions, and operations in order."""
    words = [w.lower() for w in _WORDS.findall(text or "")]
    kinds = [word_class(w) for w in words]
    sums, scored = dict.fromkeys(L.DIMENSIONS, 0.0), 0
    path: list[str] = []
    operations: list[str] = []
    for k, (word, kind) in enumerate(zip(words, kinds, strict=True)):
        if kind in ("stop", "aux"):
            continue
        found, operation = word_scores(word, kind, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "", lexicon, context)
        if operation and operations[-1:] != [step := ":".join(operation)]:
            operations.append(step)
        if not found:
            continue
        scored += 1
        for d, x in found.items():
            sums[d] += x
        top = max(L.DIMENSIONS, key=lambda d: (found.get(d, 0.0), -L.DIMENSIONS.index(d)))
        if found[top] >= DOMINANT and path[-1:] != [top]:
            path.append(top)
    grams = [">".join(path[k : k + n]) for n in (2, 3) for k in range(len(path) - n + 1)]
    return {
        "vector": [min(1.0, sums[d] / scored) if scored else 0.0 for d in L.DIMENSIONS],
        "chains": list(dict.fromkeys(grams)),
        "operations": operations,
        "op_chain": ">".join(operations) if len(operations) >= 2 else None,
    }


_TYPE = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("chains", T.ArrayType(T.StringType())),
        T.StructField("operations", T.ArrayType(T.StringType())),
        T.StructField("op_chain", T.StringType()),
    ]
)


def parser(lexicon: Lexicon | None = None, context: dict[str, dict[str, float]] | None = None):
    """The parse as an Arrow UDF: one pass, one struct.  ``context`` is of a bounded size (``corpus.propagated``)."""
    lexicon = lexicon or Lexicon()
    kind = pa.struct([("vector", pa.list_(pa.float64())), ("chains", pa.list_(pa.string())), ("operations", pa.list_(pa.string())), ("op_chain", pa.string())])

    @F.arrow_udf(_TYPE)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([parse(x.as_py(), lexicon, context) for x in text], kind)

    return run


def activation(parsed: Column, structure: Column, memory: Column | None = None, distance: float = 6.0) -> Column:
    """0.6 parse + 0.25 structure + 0.15 memory, at most 1; nearness below 3 lifts CR and IC."""
    lift = 1.0 + (3.0 - distance) * 0.1 if distance < 3.0 else 1.0
    mixed = F.zip_with(parsed, structure, lambda p, s: p * 0.6 + s * 0.25)
    if memory is not None:
        mixed = F.zip_with(mixed, memory, lambda m, b: m + b * 0.15)
    near = [d in ("CR", "IC") for d in L.DIMENSIONS]
    return F.transform(mixed, lambda a, i: F.least(F.lit(1.0), a * F.when(F.array(*map(F.lit, near))[i], lift).otherwise(1.0)))


def first_chain(chains: Column, active: Column) -> Column:
    """The first chain, else up to four active dimensions (above 0.1) by activation."""
    names = F.array(*map(F.lit, L.DIMENSIONS))
    ranked = F.array_sort(F.filter(F.transform(active, lambda a, i: F.struct((-a).alias("low"), i.alias("place"))), lambda x: x["low"] < -0.1))
    fallback = F.transform(F.slice(ranked, 1, 4), lambda x: F.element_at(names, x["place"] + 1))
    return F.when(F.size(chains) > 0, F.split(F.element_at(chains, 1), ">")).otherwise(fallback)


def chain_position(chains: Column, dimension: str) -> Column:
    """Whether a dimension mostly starts chains, stands inside or ends them; null where it is in none."""
    steps = F.transform(chains, lambda c: F.split(c, ">"))
    count = lambda test: F.size(F.filter(steps, test))
    first, last = count(lambda c: F.get(c, F.lit(0)) == dimension), count(lambda c: F.get(c, F.size(c) - 1) == dimension)
    inside = count(lambda c: F.array_contains(F.slice(c, F.lit(2), F.greatest(F.size(c) - 2, F.lit(0))), dimension))
    return F.when(first + last + inside == 0, None).when((first >= last) & (first >= inside), "initiator").when(inside >= last, "bridge").otherwise("responder")


def fragments(words: Column, scores: Column, dimension: str, least: float = 0.1, top: int = 5) -> Column:
    """The first words whose map of scores holds more than ``least`` of a dimension."""
    hits = F.filter(F.arrays_zip(words.alias("w"), scores.alias("s")), lambda x: F.coalesce(x["s"][dimension], F.lit(0.0)) > least)
    return F.slice(F.transform(hits, lambda x: x["w"]), 1, top)
