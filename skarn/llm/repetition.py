"""Repetition coverage: the share of a text's characters inside duplicated n-grams and lines.

Word hashes are combined into rolling hashes of each n-gram length in numpy; the words of every
repeated n-gram are marked once and their characters added up, so overlapping repeats do not
count twice.  A text is kept unless one of the shares is above its threshold.

The shares decide alike for short and long texts; what a text has twice by accident stays under
them from some 60 words on.

Defined results: a null or wordless text has no words and is not kept (fewer than 50 words);
repeated rows each give a row; lines without a word never count; an empty table gives no rows;
columns ``repetition``, ``base_failed`` and ``kept`` of the input are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

#: Largest share of word characters inside repeated n-grams, by n (published web-text rules).
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Odd multiplier of the rolling hash.
BASE = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
RESULT = T.StructType(
    [*(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("line_share", T.DoubleType()), T.StructField("ngram_shares", T.ArrayType(T.DoubleType()))]
)


def covered(ids: np.ndarray, n: int, later_only: bool = False) -> np.ndarray:
    """Which words lie in an n-word window that the text has more than once."""
    count = len(ids) - n + 1
    if count < 2:
        return np.zeros(len(ids), bool)
    rolled = np.zeros(count, np.uint64)
    for k in range(n):
        rolled = rolled * BASE + ids[k : k + count]
    _, first, inverse, counts = np.unique(rolled, return_index=True, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    if later_only:
        repeated[first] = False
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = tuple(NGRAM_SHARES)) -> dict:
    """Counts and shares of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        if line in seen:
            dup_lines += 1
            dup_chars += len(line)
        seen.add(line)
    ids = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    shares = [float(chars[covered(ids, n, later_only=True)].sum() / max(word_chars, 1)) for n in lengths]
    return {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": int(covered(ids, 3).sum()),
        "dup_line_chars": dup_chars,
        "line_share": dup_chars / max(len(text), 1),
        "ngram_shares": shares,
    }


@F.arrow_udf(RESULT)
def _measures(text: pa.Array) -> pa.Array:
    kind = pa.struct([*((n, pa.int64()) for n in COUNTS), ("line_share", pa.float64()), ("ngram_shares", pa.list_(pa.float64()))])
    return pa.array([measure(x.as_py()) for x in text], kind)


def repetition(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``repetition`` of the measures, ``base_failed`` and ``kept``."""
    out = docs.drop("repetition", "base_failed", "kept").withColumn("repetition", _measures(F.col(text_col)))
    r = F.col("repetition")
    failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > 50 * r["n_words"])
    bad = r["line_share"] > LINE_SHARE
    for k, limit in enumerate(NGRAM_SHARES.values()):
        bad = bad | (r["ngram_shares"][k] > limit)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)
