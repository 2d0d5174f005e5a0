"""Blocks of integer vectors: what the exact searches over embeddings share.

A table of vectors becomes blocks of at most ROWS rows, each one row of a written table, and the
queries of a block become a tile. A stated query set meets all rows tile by block: pairs of numbers
first, then payloads, a block with at most GROUP tiles in one task at a time. Memory of a task is
bounded by a block and a group of tiles, whatever one label, cell or repeated vector holds.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Rows of a block at most; tiles that meet a block in one task at most.
ROWS, GROUP = 2048, 32
#: What a matrix of a block or tile is stored as.
MATRIX = "width int, kind string, matrix binary, vec_id array<bigint>, row array<bigint>, label array<int>"


def scaled(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, v): rows that take part, with v = floor(scale * x) for x as double. Written, so that `row` is each row's own number.

    Null vectors and vectors with a null, NaN or infinite component take no part, with `label` neither do rows without one. Nor do
    vectors whose squared norm is 2**62 or more, as no 64-bit score could be exact. A vector shorter
    than others counts as followed by zeros. Rows of equal ids or vectors are rows of their own; a null id is an id after all others.
    """
    x = F.col(vector)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    norm = F.aggregate(F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (norm < 2.0**62)
    if label:
        fine &= F.col(label).isNotNull()
    chosen = df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label).cast("int") if label else F.lit(None).cast("int")).alias("label"), v.alias("v"))
    return keep(chosen.withColumn("row", F.monotonically_increasing_id()), "vectors")


def as_matrix(v: pa.Array) -> np.ndarray:
    """The lists of an Arrow column as int64 rows, shorter ones followed by zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    counts = v.value_lengths().to_numpy(zero_copy_only=False)
    width = int(counts.max(initial=0))
    out = np.zeros((len(v), width), np.int64)
    out[np.arange(width) < counts[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(m: np.ndarray) -> tuple[int, str, bytes]:
    """Width, kind and bytes of a matrix in the narrowest integers that hold it."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    kind = next(k for k in ("int8", "int16", "int32", "int64") if most <= np.iinfo(k).max)
    return m.shape[1], kind, np.ascontiguousarray(m.astype(kind)).tobytes()


class Block:
    """Rows of a block or tile: `m` int64, ids as lists, in the order of (vec_id, row), nulls last."""

    def __init__(self, r: dict):
        self.row, self.vec_id, self.label = np.asarray(r["row"], np.int64), r["vec_id"], r["label"]
        self.m = np.frombuffer(r["matrix"], r["kind"]).reshape(len(self.row), r["width"]).astype(np.int64)

    def labels(self) -> np.ndarray:
        return np.asarray(self.label, np.int64)


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return widened(a, width), widened(b, width)


def cut(batches: Iterator[pa.RecordBatch], per_block: int = ROWS) -> Iterator[tuple[int, dict, np.ndarray]]:
    """(block, its fields, its matrix) for every run of `per_block` rows of a partition, sorted by (vec_id, row)."""
    from pyspark import TaskContext

    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        ids, row = t.column("vec_id").to_pylist(), t.column("row").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, row[i]))
        m, label = as_matrix(t.column("v"))[order], t.column("label").to_pylist()
        width, kind, data = packed(m)
        return part << 24 | n, {"width": width, "kind": kind, "matrix": data, "vec_id": [ids[i] for i in order], "row": [row[i] for i in order], "label": [label[i] for i in order]}, m

    for b in batches:
        while b.num_rows:
            took = b.slice(0, per_block - size)
            held.append(took)
            size, b = size + took.num_rows, b.slice(took.num_rows)
            if size == per_block:
                yield block(held)
                n, held, size = n + 1, [], 0
    if held:
        yield block(held)


def dealt(rows: DataFrame, *by: Column, per_block: int = ROWS) -> DataFrame:
    """`rows` in partitions of about a block each, by ranges of `by` and then of row numbers, so that a hot value is split."""
    return rows.repartitionByRange(max(1, -(-rows.count() // per_block)), *by, F.xxhash64("row"))


def pairs(tiles: DataFrame, blocks: DataFrame, per_shard: int = 64) -> DataFrame:
    """Every tile beside every block, small rows both, as a join by shards of about `per_shard` blocks."""
    n = max(1, -(-blocks.count() // per_shard))
    return tiles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")), "shard").drop("shard")


def met(pairs: DataFrame, tiles: DataFrame, blocks: DataFrame, work, schema: str) -> DataFrame:
    """`work(tile row, block row)` -> Arrow batch of `schema`, for every (tile, block) of `pairs`; a block is sent once for every GROUP of its tiles.

    `tiles` and `blocks` hold a row for each number, `pairs` each pair once.
    """
    spread = F.pmod(F.xxhash64("tile"), F.lit(1 << 30))
    sized = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    keyed = pairs.join(sized, "block").withColumn("group", spread % F.col("groups"))
    left = keyed.select("block", "group").distinct().join(blocks, "block")
    right = keyed.select("tile", F.col("block").alias("to_block"), F.col("group").alias("to_group")).join(tiles, "tile")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()
        out = [work(tile, block[0]) for batch in right.to_batches(max_chunksize=1) for tile in batch.to_pylist()] if block else []
        return pa.Table.from_batches(out or [empty])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = pa.RecordBatch.from_pylist([], schema=to_arrow_schema(StructType.fromDDL(schema)))
    return left.groupBy("block", "group").cogroup(right.groupBy("to_block", "to_group")).applyInArrow(task, schema)
