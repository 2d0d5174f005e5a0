"""Quality classifier: hashed word n-gram logistic regression.

A text's tokens are its runs of word characters and its runs of other non-space characters.
Features are uni- and bigrams of lower-cased tokens, uni- to trigrams of token shapes (case,
digits, punctuation itself), and how often the text repeats its own token trigrams (shares
of trigrams by the logarithm of their count). Values are square roots of shares, so long and
short texts weigh alike. An empty text has no features: its score is the bias's.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Threshold of the registered query, labelled rows that training reads at most.
KEEP_FROM, SAMPLE = 0.3, 6000


def shape(token: str) -> str:
    if token.isalpha():
        return "c" if len(token) == 1 else "U" if token.isupper() else "T" if token.istitle() else "l" if token.islower() else "m"
    return "d" if token.isdigit() else "w" if token.isalnum() else token[:3]


class Codes(dict):
    """Token -> row of `hashes` (token, shape). Cleared between texts when it has grown large."""

    def __init__(self):
        self.rows: list[tuple[int, int]] = []

    def __missing__(self, token: str) -> int:
        import xxhash

        self.rows.append((xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape(token))))
        self[token] = n = len(self.rows) - 1
        return n


def features():
    """A callable text -> (slots, values)."""
    codes = Codes()
    table = np.zeros((0, 2), np.uint64)

    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        nonlocal codes, table
        if len(codes) > 300_000:
            codes, table = Codes(), np.zeros((0, 2), np.uint64)
        known = len(codes.rows)
        at = [codes[t] for t in TOKEN.findall(text)]
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(codes.rows) > known:
            table = _grown(table, known, codes.rows)
        both = table[np.asarray(at)]
        word, kind = both[:, 0], both[:, 1]
        pair, kinds = word[:-1] * linear.M1 + word[1:] * linear.M3, kind[:-1] * linear.M1 + kind[1:] * linear.M3
        three = pair[:-1] * linear.M2 + word[2:]
        streams = [linear.slots(x, s) for s, x in enumerate((word, pair, kind, kinds, kinds[:-1] * linear.M2 + kind[2:]), 1)]
        repeats = np.unique(three, return_counts=True)[1] if three.size else np.zeros(0, np.int64)
        found = [np.unique(x, return_counts=True) for x in streams if x.size]
        i, x = [f[0] for f in found], [np.sqrt(f[1] / f[1].sum()) for f in found]
        if repeats.size:
            share = np.bincount(np.minimum(np.log2(repeats).astype(int), 8), repeats) / repeats.sum()
            i.append(linear.slots(np.arange(share.size, dtype=np.uint64), 9))
            x.append(np.sqrt(share))
        return np.concatenate(i).astype(np.int64), np.concatenate(x)

    return of


def _grown(table: np.ndarray, known: int, rows: list) -> np.ndarray:
    """The table with the new rows, in a copy of twice the size when it is full."""
    new = np.asarray(rows[known:], np.uint64)
    if len(table) < len(rows):
        table = np.concatenate([table[:known], np.zeros((len(rows), 2), np.uint64)])
    table[known : len(rows)] = new
    return table


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether a row is in the fold; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> np.ndarray:
    """Weights from at most `limit` labelled rows, none of which is in the held-out fold (crc32 of the key mod 5 is 0)."""
    return linear.fit(docs, linear.labelled_sample(labels, "quality", ~held_out("doc_id", 5, 0), limit), features)


def scored(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, into: str = "score") -> DataFrame:
    """`docs` with each whole text's quality in `into` (0 to 1); all rows and other columns stay."""
    return linear.score(docs, train(docs, labels, limit), features, into=into)


def digest(df: DataFrame) -> DataFrame:
    """The columns that the registered query returns, from doc_id and score."""
    return df.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
