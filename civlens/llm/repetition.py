"""Quality rules: repetition coverage by rolling hashes of word n-grams, in numpy.

A text fails when too large a share of its word characters lies inside n-grams of some length that
occur twice or more in it, or inside lines equal to an earlier line. Hashes of length n roll from
those of n - 1, and only places whose shorter n-gram is repeated are looked at again.

Base rules: fewer than 50 words, or more than half of the words inside repeated 3-word windows
(found exactly, by word numbers). Null or empty text: no words, so it fails the base rules. Null
doc_id: kept as null. Repeated rows: each gets the same result. Empty table: no rows. Other columns
are ignored. A text is held whole, its n-grams as numpy arrays (about 100 bytes a word).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Share of word characters inside repeated n-grams that a text may have, by n. The first occurrence
#: counts as well, so they are twice the usual limits on repeated text.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Share of lines, and of their characters, that equal an earlier line.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeat_chars array<double>, dup_line_chars double"
)


def _mixed(n: int) -> np.ndarray:
    """Well-spread 64-bit numbers for word numbers 0 to n - 1."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places inside the n-grams that begin at ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> dict:
    words = text.encode().split()  # splits at exactly the six characters of SPACES
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen, repeats, repeat_chars_in_lines = set(), 0, 0
    for x in lines:
        if x in seen:
            repeats += 1
            repeat_chars_in_lines += len(x) - sum(map(x.count, SPACES))
        seen.add(x)
    vocabulary = dict.fromkeys(words)
    number = dict(zip(vocabulary, range(len(vocabulary)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    n_repeat, shares = 0, {k: 0.0 for k in NGRAM_LIMITS}
    if n > 3:
        size = len(vocabulary)
        pair = ids[:-1] * size + ids[1:]
        if size >= 1 << 21:  # three numbers don't fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        at = np.flatnonzero(_repeated(pair[:-1] * size + ids[2:]))
        if len(at):
            n_repeat = int(_covered(at, 3, n).sum())
            # a length in code points for each word
            lens = np.fromiter((len(w) if w.isascii() else len(w.decode()) for w in vocabulary), np.int64, size)[ids]
            value = _mixed(size)[ids]
            power = np.uint64(1)
            rolled = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(max(NGRAM_LIMITS)):
                    # rolled: hashes of the n-grams of length k + 1 that begin at ``at``
                    fits = at + k < n
                    at, rolled = at[fits], rolled[fits]
                    rolled = rolled + value[at + k] * power
                    power = power * _BASE
                    if k >= 3:
                        again = _repeated(rolled)
                        at, rolled = at[again], rolled[again]
                    if k + 1 in shares and len(at):
                        shares[k + 1] = float(lens[_covered(at, k + 1, n)].sum()) / max(chars, 1)
                    if not len(at):
                        break
    failed = n < 50 or 100 * n_repeat > 50 * n
    line_chars = repeat_chars_in_lines / max(chars, 1)
    bad = any(shares[k] > limit for k, limit in NGRAM_LIMITS.items())
    bad = bad or repeats > LINE_LIMIT * len(lines) or line_chars > LINE_CHARS_LIMIT
    return {
        "n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": repeats,
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": not (failed or bad),
        "repeat_chars": list(shares.values()), "dup_line_chars": line_chars,
    }


def measured(docs: DataFrame) -> DataFrame:
    """Base counts, repetition coverage and verdict of every document."""

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([measure(t or "") for t in pdf["text"]])
            rows.insert(0, "doc_id", pdf["doc_id"])
            yield rows

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text").mapInPandas(run, RESULT)
    return rows.withColumn("doc_id", rows["doc_id"].cast("long"))


def op9_repetition(spark, sf_dir: str) -> DataFrame:
    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
