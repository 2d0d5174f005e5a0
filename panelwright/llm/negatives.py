"""Hard negatives from integer scores that a residue number system computes exactly.

Component matrices are kept as their remainders modulo several small primes, in one byte each. Remainders are
multiplied as float32 matrices, where every partial sum stays below 2**24 and so is exact, and the products
modulo each prime are put together by Chinese remaindering (balanced mixed radix), which gives the exact signed
score. There are as many primes as the largest possible score needs. Anchors of a block form a tile that meets
blocks: first those with rows of its labels, for the positives, then all, for the negatives in each
positive's window; what a block gives is ranked by windows over anchor and positive.

Rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors count as followed
by zeros; ties go to the smaller id (null ids last); repeated rows and ids are rows of their own. An empty table gives no rows, as does
a positive without a negative in its window. Columns besides the three named are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import keep

#: Odd primes under 256, largest first: their balanced remainders fit in a byte.
PRIMES = [p for p in range(255, 2, -1) if all(p % q for q in range(2, 16))]
#: Columns of one float32 product: as many as keep sums of products of remainders (at most 125 each) under 2**24.
DEPTH = (1 << 24) // (125 * 125)
LEAST = -(1 << 63)


def moduli(most: float) -> list[int]:
    """The primes whose product exceeds twice the largest absolute score, and with it every signed score's range."""
    chosen, product = [], 1
    for p in PRIMES:
        if chosen and product > 2.001 * most + 3:
            break
        chosen.append(p)
        product *= p
    return chosen


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders modulo an odd p, from -(p - 1) / 2 to (p - 1) / 2."""
    half = (p - 1) // 2
    return (x + half) % p - half


def remainders(m: np.ndarray, primes: list[int]) -> np.ndarray:
    """(prime, row, column) balanced remainders as bytes."""
    return np.stack([balanced(m, p) for p in primes]).astype(np.int8)


def gemm(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Balanced remainders of the products of the rows of `a` with the rows of `b`, themselves balanced remainders."""
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        part = a[:, k : k + DEPTH].astype(np.float32) @ b[:, k : k + DEPTH].astype(np.float32).T
        total += part.astype(np.int64)
    return balanced(total, p)


def restored(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their balanced remainders: digits of a balanced mixed radix, summed modulo 2**64."""
    digits: list[np.ndarray] = []
    for x, p in zip(parts, primes):
        left = x
        for d, q in zip(digits, primes):
            left = balanced((left - d) * pow(q, -1, p), p)
        digits.append(left)
    value, weight = digits[0].astype(np.uint64), 1
    for d, q in zip(digits[1:], primes):
        weight = weight * q % (1 << 64)
        value = value + d.astype(np.uint64) * np.uint64(weight)
    return value.astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact scores of the rows behind two arrays of remainders."""
    if a.shape[2] != b.shape[2]:
        width = max(a.shape[2], b.shape[2])
        a, b = (np.pad(x, ((0, 0), (0, 0), (0, width - x.shape[2]))) for x in (a, b))
    return restored([gemm(x, y, p) for x, y, p in zip(a, b, primes)], primes)


def firsts(masked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row that aren't LEAST, ties to the smaller column."""
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        row, column = np.nonzero((masked >= kth[:, None]) & (masked != LEAST))
    else:
        row, column = np.nonzero(masked != LEAST)
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def ceil_part(x: np.ndarray) -> np.ndarray:
    """The least integer y with 100 * y >= 80 * x, without leaving 64 bits."""
    return x - x // 5


def mine(df: DataFrame, n_positives: int = 5, n_negatives: int = 5, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows whose id is divisible by `every`.

    `df` has its final labels. A positive is one of an anchor's first `n_positives` other rows of its label, negatives are the first `n_negatives`
    rows of other labels from four fifths of the positive's score up to it; first is by score, then by smaller id.
    """
    rows = vectors.scaled(df, vec_id, vector, label)
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()[0]
    if largest is None:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    primes = moduli(largest)

    def residues(m: np.ndarray) -> bytes:
        return remainders(m, primes).tobytes()

    def opened(held: dict) -> np.ndarray:
        return np.frombuffer(held["matrix"], np.int8).reshape(len(primes), len(held["row"]), held["width"])

    def pack(batches):
        for number, fields, m in vectors.cut(batches):
            ask = [i for i, x in enumerate(fields["vec_id"]) if x is not None and x % every == 0]
            part = lambda at: {"width": m.shape[1], "matrix": residues(m[at])} | {key: [fields[key][i] for i in at] for key in ("vec_id", "row", "label")}
            labels = lambda at: sorted({fields["label"][i] for i in at})
            yield pa.RecordBatch.from_pylist([{"block": number, "held": part(range(len(m))), "labels": labels(range(len(m))), "asks": part(ask), "asked": labels(ask)}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    held = "struct<width:int, matrix:binary, vec_id:array<bigint>, row:array<bigint>, label:array<int>>"
    ddl = f"block bigint, held {held}, labels array<int>, asks {held}, asked array<int>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    blocks = keep(vectors.dealt(rows, F.col("label")).mapInArrow(pack, ddl), "blocks")
    asking = blocks.where(F.size("asked") > 0)
    pairs = keep(vectors.pairs(asking.select(F.col("block").alias("tile"), "asked"), blocks.select("block", "labels")), "pairs")
    matrices = blocks.select("block", "held")
    tiles = asking.select(F.col("block").alias("tile"), "asks")

    def positive(tile: dict, block: dict) -> pa.RecordBatch:
        asks, held = tile["asks"], block["held"]
        s = scores(opened(asks), opened(held), primes)
        ours, theirs = np.asarray(asks["label"], np.int64), np.asarray(held["label"], np.int64)
        other = np.asarray(asks["row"], np.int64)[:, None] != np.asarray(held["row"], np.int64)[None, :]
        i, j = firsts(np.where(other & (ours[:, None] == theirs[None, :]), s, LEAST), n_positives)
        names = ["tile", "place", "positive_row", "positive_id", "positive_score"]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tile["tile"], np.int64)), pa.array(i.astype(np.int32)), pa.array(np.asarray(held["row"], np.int64)[j]), pa.array([held["vec_id"][x] for x in j], pa.int64()), pa.array(s[i, j])], names)

    found = vectors.met(pairs.where(F.arrays_overlap("asked", "labels")).select("tile", "block"), tiles, matrices, positive, "tile bigint, place int, positive_row bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("tile", "place").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "positive_row")
    chosen = found.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n_positives)
    windows = keep(chosen.groupBy("tile").agg(F.collect_list(F.struct("place", "__rank", "positive_id", "positive_score")).alias("windows")), "windows")

    def negative(tile: dict, block: dict) -> pa.RecordBatch:
        asks, held, windows = tile["asks"], block["held"], tile["windows"]
        s = scores(opened(asks), opened(held), primes)
        place = np.asarray([w["place"] for w in windows])
        high = np.asarray([w["positive_score"] for w in windows], np.int64)
        s = s[place]
        other = np.asarray(asks["label"], np.int64)[place][:, None] != np.asarray(held["label"], np.int64)[None, :]
        i, j = firsts(np.where(other & (s >= ceil_part(high)[:, None]) & (s <= high[:, None]), s, LEAST), n_negatives)
        got = [(tile["tile"], windows[x]["place"], windows[x]["__rank"], asks["vec_id"][windows[x]["place"]], windows[x]["positive_id"], windows[x]["positive_score"], held["vec_id"][y], held["row"][y]) for x, y in zip(i.tolist(), j.tolist())]
        return pa.RecordBatch.from_arrays([*(pa.array([g[c] for g in got], pa.int32() if c in (1, 2) else pa.int64()) for c in range(8)), pa.array(s[i, j])], NAMES)

    NAMES = ["tile", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "row", "negative_score"]
    mixed = ~((F.size("asked") == 1) & (F.size("labels") == 1) & (F.get("asked", 0) == F.get("labels", 0)))
    near = vectors.met(pairs.where(mixed).select("tile", "block"), tiles.join(windows, "tile"), matrices, negative, "tile bigint, place int, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, row bigint, negative_score bigint")
    w = Window.partitionBy("tile", "place", "nth").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "row")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mislabelled(df: DataFrame, every: int = 7, classes: int = 10, vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """Rows whose id is divisible by `every` get the next of the classes as their label."""
    return df.withColumn(label, F.when(F.col(vec_id) % every == 0, F.pmod(F.col(label) + 1, F.lit(classes))).otherwise(F.col(label)))


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.rid AS arid, c.vec_id, c.rid, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) AS n FROM s WHERE same) WHERE n <= 5
), m AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid)::INTEGER AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 5
"""
