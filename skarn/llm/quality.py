"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or abstain on whole texts.  The votes of all documents are
counted by pattern (at most 3**labellers patterns, whatever the size of the table);
expectation-maximisation over those counts estimates how often each labeller votes what on good
and on bad documents, and gives each pattern its posterior.  The posteriors of a bounded,
hash-chosen sample (SAMPLE_ROWS expected rows, repeated rows once) train a logistic scorer over hashed word shapes
and binned measures, which then scores every text.

Defined results: a null or wordless text gets the votes of an empty one and is rejected by the
rule EMPTY_KEPT; a score of exactly one half keeps; repeated rows each give a row; an empty table
gives no rows; columns ``quality_score`` and ``quality_keep`` of the input are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

#: Measures and the limits of their votes: good up to the first, bad from the second on.
LABELLERS = {
    "symbols": (0.10, 0.30),  # marks per word
    "repeats": (0.05, 0.20),  # words equal to the word before
    "capitals": (0.25, 0.50),  # capitals among letters
    "open_lines": (0.50, 0.80),  # lines that do not end a sentence
    "letterless": (0.05, 0.15),  # words without a letter
    "poverty": (0.70, 0.85),  # words that are not the first of their kind, in windows of WINDOW
}
ABSTAIN, BAD, GOOD = 0, 1, 2
WINDOW = 64
SYMBOLS = b"#*$%&|<>!"
FEATURES = 1 << 12
SAMPLE_ROWS = 4096
EMPTY_KEPT = False
SEED = 9

_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"([Aa0])\1+")
_END = re.compile(rb"[.!?\"')\]][ \t\r]*$", re.M)
_LINE = re.compile(rb"[^ \t\r\x0b\x0c\n][^\n]*")


def measures(data: bytes, words: list[bytes]) -> dict[str, float]:
    n = len(words)
    shape = data.translate(_CLASS)
    capitals, letters = shape.count(b"A"), shape.count(b"a")
    lines = len(_LINE.findall(data))
    poor = sum(len(words[k : k + WINDOW]) - len(set(words[k : k + WINDOW])) for k in range(0, n, WINDOW))
    return {
        "symbols": sum(map(data.count, (bytes([c]) for c in SYMBOLS))) / n,
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / n,
        "capitals": capitals / max(1, capitals + letters),
        "open_lines": 1 - min(1.0, len(_END.findall(data)) / max(1, lines)),
        "letterless": sum(1 for w in shape.split() if b"a" not in w and b"A" not in w) / n,
        "poverty": poor / n,
    }


def votes(found: dict[str, float] | None) -> list[int]:
    """One vote per labeller; an empty text has no good side."""
    if found is None:
        return [BAD] * len(LABELLERS)
    return [GOOD if found[k] <= good else BAD if found[k] >= bad else ABSTAIN for k, (good, bad) in LABELLERS.items()]


def features(data: bytes, words: list[bytes], found: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and weights: word shapes by root share, and binned measures."""
    if found is None:
        return np.zeros(1, np.int64), np.ones(1)
    shapes = Counter(_RUNS.sub(rb"\1", data.translate(_CLASS)).split())
    names = [b"s:" + s for s in shapes] + [b"m:%s:%d" % (k.encode(), min(9, int(v * 10))) for k, v in found.items()]
    values = [(c / len(words)) ** 0.5 for c in shapes.values()] + [1.0] * len(found)
    slots = np.fromiter((xxh64_intdigest(x, SEED) % FEATURES for x in names), np.int64, len(names))
    return slots, np.array(values)


def _read(text: str | None) -> tuple[bytes, list[bytes], dict[str, float] | None]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    return data, words, measures(data, words) if words else None


def pattern(text: str | None) -> int:
    code = 0
    for v in votes(_read(text)[2]):
        code = 3 * code + v
    return code


@F.arrow_udf(T.IntegerType())
def _patterns(text: pa.Array) -> pa.Array:
    return pa.array([pattern(x.as_py()) for x in text], pa.int32())


@F.arrow_udf(T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
def _examples(text: pa.Array) -> pa.Array:
    out = []
    for x in text:
        data, words, found = _read(x.as_py())
        slots, values = features(data, words, found)
        code = 0
        for v in votes(found):
            code = 3 * code + v
        out.append({"pattern": code, "slots": slots, "values": values})
    return pa.array(out, pa.struct([("pattern", pa.int32()), ("slots", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))


def posteriors(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """P(good) of each pattern, by expectation-maximisation over counts of patterns."""
    if not counts:
        return {}
    k = len(LABELLERS)
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    digits = np.stack([codes // 3**j % 3 for j in range(k - 1, -1, -1)], 1)
    bad, good = (digits == BAD).sum(1), (digits == GOOD).sum(1)
    p = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.5))
    for _ in range(rounds):
        like = np.zeros((2, len(codes)))
        for c, w in enumerate((n * (1 - p), n * p)):
            prior = (w.sum() + 1) / (n.sum() + 2)
            like[c] = np.log(prior)
            for j in range(k):
                table = np.bincount(digits[:, j], w, 3) + 1
                like[c] += np.log(table / table.sum())[digits[:, j]]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def train(examples: list[tuple[list[int], list[float], float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias), by full gradients with momentum."""
    weights = np.zeros(FEATURES + 1)
    if not examples:
        return weights
    row = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
    slot = np.concatenate([np.asarray(e[0], np.int64) for e in examples])
    value = np.concatenate([np.asarray(e[1], float) for e in examples])
    want = np.array([e[2] for e in examples])
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        z = np.bincount(row, value * weights[slot], len(examples)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - want) / len(examples)
        slope = np.append(np.bincount(slot, value * error[row], FEATURES), error.sum()) + decay * weights
        speed = 0.9 * speed - rate * slope
        weights += speed
    return weights


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    text = F.col(text_col)
    counts = {r["p"]: r["count"] for r in docs.select(_patterns(text).alias("p")).groupBy("p").count().collect()}
    posterior = posteriors(counts)
    share = min(1.0, sample_rows / max(1, sum(counts.values())))
    keyed = docs.select(F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("key"), text.alias("text"))
    chosen = keyed.where(F.pmod("key", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).dropDuplicates(["key"])
    sample = chosen.select("key", _examples("text").alias("e")).select("key", "e.*").collect()
    sample.sort(key=lambda r: r.key)  # sums in one order, so that reruns agree
    return train([(r.slots, r["values"], posterior[r.pattern]) for r in sample])


def scorer(weights: np.ndarray):
    """A UDF: P(good) of a text."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        out = np.empty(len(text))
        for k, x in enumerate(text):
            data, words, found = _read(x.as_py())
            slots, values = features(data, words, found)
            z = float(values @ weights[slots] + weights[-1])
            out[k] = 1 / (1 + np.exp(-min(50.0, max(-50.0, z)))) if words or EMPTY_KEPT else 0.0
        return pa.array(out)

    return score


def classify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_keep``."""
    score: Column = scorer(fit(docs, text_col, id_col))(F.col(text_col))
    return docs.withColumn("quality_score", score).withColumn("quality_keep", F.col("quality_score") >= 0.5)
