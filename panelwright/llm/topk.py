"""Exact top-k search by inner product with a table of distances to pivots.

Pivots are chosen once from a bounded sample (each the farthest from those before it); every row of the
table gets its distances to all of them. |d(q, p) - d(c, p)| is a lower bound of the distance of q and c, the
largest over all pivots is used, and as score = (|q|^2 + |c|^2 - d^2) / 2 it gives an upper bound of the
score. Rows are dealt into blocks by their nearest pivot. A query is searched in its own block first,
which gives its k-th best score so far; other blocks are dropped where even the bound of the whole
block is below that of each query of a tile. In a block, candidates are evaluated in the order of their
bounds until the next bound is below the k-th best score: no later candidate can reach it, so
results are exact for any pivots and any data. How much is dropped depends on the data.

Null vectors and vectors with null or non-finite components take no part, shorter vectors count as followed by zeros, ties go
to the smaller id (null ids last), repeated rows and ids are rows of their own. An empty table gives no rows. Columns besides the two named are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import keep

#: Pivots, and rows of the sample from which they are chosen (those of smallest hash).
PIVOTS, SAMPLE = 32, 1024
LEAST = -(1 << 63)
FOUND = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
NAMES = ["query_row", "query_id", "vec_id", "row", "score"]


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it; the first is the farthest from the middle."""
    x = sample.astype(np.float64)
    far, chosen = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(min(n, len(x))):
        chosen.append(int(far.argmax()))
        gone = ((x - x[chosen[-1]]) ** 2).sum(1)
        far = gone if len(chosen) == 1 else np.minimum(far, gone)
        if not far.any():
            break
    return sample[chosen]


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, float64; no cancelling of large norms."""
    a, b = vectors.same_width(m, pivots)
    out = np.empty((len(a), len(b)))
    for j, p in enumerate(b.astype(np.float64)):
        out[:, j] = np.sqrt(((a - p) ** 2).sum(1))
    return out


def norms(m: np.ndarray) -> np.ndarray:
    return (m * m).sum(1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of `a` with the rows of `b`: in float64 where every sum stays below 2**53."""
    a, b = vectors.same_width(a, b)
    if float(norms(a).max(initial=0)) * float(norms(b).max(initial=0)) < 2.0**104:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(dq: np.ndarray, nq: np.ndarray, dc: np.ndarray, nc: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries with candidates from their distances to the pivots, with room for rounding."""
    low, work = np.zeros((len(dq), len(dc))), np.empty((len(dq), len(dc)))
    for p in range(dq.shape[1]):
        np.subtract(dq[:, p, None], dc[None, :, p], out=work)
        np.maximum(low, np.abs(work, out=work), out=low)
    low -= 1e-9 * (np.sqrt(nq.astype(np.float64))[:, None] + np.sqrt(nc.astype(np.float64))[None, :] + 1)
    np.maximum(low, 0, out=low)
    total = nq.astype(np.float64)[:, None] + nc.astype(np.float64)[None, :]
    return (total - low * low) / 2 + 1e-12 * total + 0.5


def best(scores: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their places, ties to the smaller place."""
    order = np.lexsort((at, -scores))[:k]
    return scores[order], at[order]


def search(queries: vectors.Block, dq: np.ndarray, block: vectors.Block, dc: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (scores, places) of up to k candidates of the block that reach its floor; its own row is none."""
    if not len(queries.row) or not len(block.row):
        return [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries.row)
    q, c = vectors.same_width(queries.m, block.m)
    upper = bounds(dq, norms(q), dc, norms(c))
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero((upper[i] >= floor[i]) & (block.row != queries.row[i]))
        alive = alive[np.argsort(-upper[i, alive], kind="stable")]
        got, places, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 8 * k
        while at < len(alive) and not (len(got) == k and upper[i, alive[at]] < got[-1]):
            part = alive[at : at + step]
            got, places = best(np.append(got, products(q[i : i + 1], c[part])[0]), np.append(places, part), k)
            at, step = at + step, 2 * step
        enough = got >= floor[i]
        out.append((got[enough], places[enough]))
    return out


def found_rows(queries: vectors.Block, block: vectors.Block, hits) -> list[pa.Array]:
    rows = [(int(queries.row[i]), queries.vec_id[i], block.vec_id[j], int(block.row[j]), s) for i, (scores, places) in enumerate(hits) for s, j in zip(scores.tolist(), places.tolist())]
    return [pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by `every`."""
    rows = vectors.scaled(df, vec_id, vector)
    sample = rows.select("v", F.xxhash64("v", "vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose_pivots(vectors.as_matrix(sample.column("v")))

    def near(batches):
        for b in batches:
            d = distances(vectors.as_matrix(b.column("v")), pivots)
            yield b.append_column("cell", pa.array(d.argmin(1).astype(np.int32))).append_column("near", pa.array(d.min(1)))

    def pack(batches):
        for number, fields, m in vectors.cut(batches):
            d, whole = distances(m, pivots), vectors.Block(fields)
            ask = [i for i, x in enumerate(fields["vec_id"]) if x is not None and x % every == 0]
            tile = {"width": fields["width"], "kind": fields["kind"], "matrix": m[ask].astype(fields["kind"]).tobytes()} | {key: [fields[key][i] for i in ask] for key in ("vec_id", "row", "label")}
            queries = vectors.Block(tile)
            hits = search(queries, d[ask], whole, d, k, np.full(len(ask), LEAST))
            floor = [int(s[-1]) if len(s) == k else LEAST for s, _ in hits]
            reach = {"low": d.min(0).tolist(), "high": d.max(0).tolist(), "most": float(norms(m).max())}
            asked = {"low": d[ask].min(0).tolist(), "high": d[ask].max(0).tolist(), "most": float(norms(queries.m).max()), "floor": min(floor)} if ask else None
            found = pa.RecordBatch.from_arrays(found_rows(queries, whole, hits), NAMES).to_pylist()
            yield pa.RecordBatch.from_pylist([{"block": number, "held": fields | {"d": d.tobytes()}, "reach": reach, "tile": tile | {"d": d[ask].tobytes(), "floor": floor}, "asked": asked, "found": found}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    inner = lambda ddl: ", ".join(x.replace(" ", ":", 1) for x in ddl.split(", "))
    span = "low:array<double>, high:array<double>, most:double"
    ddl = f"block bigint, held struct<{inner(vectors.MATRIX)}, d:binary>, reach struct<{span}>, tile struct<{inner(vectors.MATRIX)}, d:binary, floor:array<bigint>>, asked struct<{span}, floor:bigint>, found array<struct<{inner(FOUND)}>>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    celled = rows.mapInArrow(near, "vec_id bigint, label int, v array<bigint>, row bigint, cell int, near double")
    blocks = keep(vectors.dealt(celled, F.col("cell"), F.col("near")).mapInArrow(pack, ddl), "blocks")

    # Numbers and bounds only: a pair stays if the bound of the whole block reaches the lowest floor of the tile.
    pairs = vectors.pairs(blocks.where("asked IS NOT NULL").select(F.col("block").alias("tile"), "asked"), blocks.select("block", "reach")).where("block <> tile")
    gaps = F.zip_with(F.zip_with("asked.low", "reach.high", lambda x, y: x - y), F.zip_with("reach.low", "asked.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    total = F.col("asked.most") + F.col("reach.most")
    low = F.greatest(F.lit(0.0), F.array_max(gaps) - 1e-9 * (F.sqrt("asked.most") + F.sqrt("reach.most") + 1))
    pairs = pairs.where((total - low * low) / 2 + 1e-12 * total + 0.5 >= F.col("asked.floor")).select("tile", "block")

    def meet(tile: dict, block: dict) -> pa.RecordBatch:
        queries, other = vectors.Block(tile["asks"]), vectors.Block(block["held"])
        dq, dc = (np.frombuffer(x["d"]).reshape(n, -1) for x, n in ((tile["asks"], len(queries.row)), (block["held"], len(other.row))))
        return pa.RecordBatch.from_arrays(found_rows(queries, other, search(queries, dq, other, dc, k, np.asarray(tile["asks"]["floor"], np.int64))), NAMES)

    found = vectors.met(pairs, blocks.select(F.col("block").alias("tile"), F.col("tile").alias("asks")), blocks.select("block", "held"), meet, FOUND)
    own = blocks.select(F.explode("found").alias("f")).select("f.*")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return own.union(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.rid AS qrid, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score, c.rid
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id NULLS LAST, rid)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
