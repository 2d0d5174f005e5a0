"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning thins them, exact sets decide.

Texts are sets of shingles of five words (a text of fewer words is one shingle; words are runs
of code points other than space and \\x09-\\x0D). Two texts are linked if their Jaccard
similarity is `threshold` or more.

1. Equal texts become one text with a weight; a signature has 128 MinHash values of 16 bits,
   and 32 bands of four values: a pair at 0.8 shares no band with probability 5e-8.
2. In each bucket of a band (buckets with the same members once), values of pairs are compared
   16 at a time; a pair is dropped as soon as the posterior probability of reaching the threshold
   (uniform prior) is under `tolerance`. Pairs that last connect candidate groups; only
   spanning edges leave a task.
3. Within each candidate group the pairs that last the same comparison are decided on the exact
   shingle sets; pairs that are dropped cost no more than their first values. Each text's number
   of links and spanning edges leave the task, never all pairs.

Buckets and groups of more than a tile are split: every pair of tiles is a task of its own, so
none holds more than two tiles, and no pair is capped or skipped. Components of the links
are the classes.

Null texts are empty; equal texts, empty ones too, share a class. Rows with a null key stay, with
null class and no links. Rows with equal keys and texts are copies of one document; texts
are told apart by their 128-bit digest, so rows with equal keys and different texts are judged each by its
own text. Keys may be of any type that has an order. Other columns are not returned.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .wordhash import A, WordHashes, grams, mixed

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
HASHES, BANDS, STEP, FEW = 128, 32, 16, 32
TILE, TILE_CHARS = 512, 4_000_000


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of word hashes."""
    return np.unique(mixed(grams(h, min(n, len(h)), A))) if len(h) else h


def multipliers() -> np.ndarray:
    return mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * A[0]) | np.uint64(1)


def signature(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """128 MinHash values, 16 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(x), 2048):
        y = x[None, i : i + 2048] * a[:, None]
        np.minimum(least, (y ^ (y >> np.uint64(32))).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest matches with which P(similarity >= threshold) is `tolerance` or more.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1), and its mass
    above t is the probability of at most m successes in n + 1 trials of chance t.
    """
    from math import comb

    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


class Sets:
    """Disjoint sets of 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[x]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]


def lasting(sig: np.ndarray, x: int, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Those of `others` whose pair with x is not dropped."""
    matches = np.zeros(len(others), np.int64)
    for n, enough in least.items():
        if n > sig.shape[1]:
            break
        matches += (sig[others, n - STEP : n] == sig[x, n - STEP : n]).sum(axis=1)
        others, matches = others[matches >= enough], matches[matches >= enough]
        if not len(others):
            break
    return others


def tile_pairs(rows: DataFrame, tiles: Column, key: str = "key") -> DataFrame:
    """Each row once for every pair of tiles that has its tile; `tile`, and the pair in `i` <= `j`. One tile: once."""
    d = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), key), F.col("tiles")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    return d.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other", "tiles")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key of `edges` (a, b): root is the smallest key of its component. Large-star and small-star rounds on written tables; the number of rounds grows with the logarithm of the longest path."""
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near-least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = keep(large, "near-large")
        least = keep(large.groupBy("b").agg(F.min("a").alias("m")), "near-least")
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m"), F.col("a"))).where("a <> b")
        edges = keep(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")
        after = mark(edges)
        if after == before:
            stars = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("key"), "root")
            return stars.union(stars.select("root", "root").distinct())
        before = after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, class_id, n_links, n_copies, is_first, text_md5) of every row.

    class_id: the smallest key of the component; n_links: documents with a different text
    that is linked; n_copies: other documents with the same text; is_first: whether the row has the
    text that stands for the class (the smallest key's; among several the one of least digest) and that key.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("same"))
    kind = docs.schema["key"].dataType.simpleString()
    least = least_matches(threshold, tolerance)
    tenths = round(threshold * 10_000)

    def signed(batches):
        hashes, a = WordHashes(), multipliers()
        for b in batches:
            sig = [signature(x, a).tobytes() if len(x) else None for x in map(shingles, hashes.of(b.column("text")))]
            chars = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("same"), pa.array(sig, pa.binary()), chars], ["key", "same", "sig", "chars"])

    signatures = keep(docs.mapInArrow(signed, f"key {kind}, same binary, sig binary, chars long"), "near-signatures")
    texts = signatures.where("key IS NOT NULL").groupBy("same").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n"))
    # Numbers of the written table's rows: unlike keys, one for each text.
    texts = keep(texts.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    one = texts.select(F.col("id").alias("key"), F.col("first").alias("f"), F.col("same").alias("s")).join(signatures.where("sig IS NOT NULL"), (F.col("f") == signatures["key"]) & (F.col("s") == F.col("same"))).drop(signatures["key"])
    one = keep(one.select("key", "sig", "chars").dropDuplicates(["key"]), "near-one")

    # Buckets with two members or more, each set of members once.
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 8 * i + 1, 8))
    banded = one.select("key", F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"))
    many = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.bit_xor(F.xxhash64("key")).alias("x")).where("n > 1")
    many = keep(many.groupBy("n", "a", "x").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("n").alias("members")), "near-buckets")
    rows = banded.join(many, "bucket").join(one.select("key", "sig"), "key")

    def signed_rows(table):
        return np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(table), -1)

    def connect(table):
        keys, sig, sets = table.column("key").to_numpy(), signed_rows(table), Sets(len(table))
        for x in range(len(keys) - 1):
            others = x + 1 + np.flatnonzero(sets.root[x + 1 :] != sets.root[x])
            if len(others):
                sets.join(x, lasting(sig, x, others, least))
        b = np.flatnonzero(sets.root != np.arange(len(keys)))
        return pa.table({"a": pa.array(keys[sets.root[b]]), "b": pa.array(keys[b])})

    tiled = tile_pairs(rows, F.ceil(F.col("members") / TILE))
    edges = tiled.groupBy("bucket", "i", "j").applyInArrow(connect, "a long, b long")
    groups = keep(components(edges), "near-groups")
    about = texts.select(F.col("id").alias("key"), "first", "same", "n")
    sizes = groups.join(one.select("key", "chars"), "key").groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("chars").alias("all_chars"))
    member = groups.join(keep(sizes, "near-sizes"), "root").join(about, "key").withColumnRenamed("same", "digest")
    # The first values are enough to drop most pairs that the exact sets need not see.
    member = member.join(one.select("key", F.substring("sig", 1, 2 * FEW).alias("sig")), "key")
    full = member.join(docs.withColumnRenamed("key", "of"), (F.col("first") == F.col("of")) & (F.col("digest") == F.col("same"))).dropDuplicates(["key"])

    def verify(table):
        table = table.sort_by("tile")
        keys, tile, weight = (table.column(c).to_numpy() for c in ("key", "tile", "n"))
        apart = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sig, hashes = signed_rows(table), WordHashes()
        found = [shingles(h) for part in table.column("text").chunks for h in hashes.of(part)]
        ids = np.unique(np.concatenate(found), return_inverse=True)[1]
        size = np.asarray([len(x) for x in found])
        starts = np.cumsum(size) - size
        links, sets, seen = np.zeros(len(keys), np.int64), Sets(len(keys)), np.zeros(ids.max() + 1, np.int64)
        # Two tiles: the rows of one with those of the other; one tile: each row with those after it.
        second = int(np.searchsorted(tile, tile[-1])) if apart else len(keys)
        for x in range(second):
            others = lasting(sig, x, np.arange(second if apart else x + 1, len(keys)), least)
            if not len(others):
                continue
            own, low = ids[starts[x] : starts[x] + size[x]], int(others[0])
            seen[own] = 1
            if 3 * len(others) > len(keys) - low:
                shared = np.add.reduceat(seen[ids[starts[low] :]], starts[low:] - starts[low])[others - low]
            else:
                shared = np.asarray([seen[ids[starts[o] : starts[o] + size[o]]].sum() for o in others.tolist()])
            seen[own] = 0
            at = others[shared * 10_000 >= tenths * (size[others] + size[x] - shared)]
            links[x] += weight[at].sum()
            links[at] += weight[x]
            if len(at):
                sets.join(x, at)
        return pa.table({"key": pa.array(keys), "links": pa.array(links), "root": pa.array(keys[sets.root])})

    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("all_chars") / TILE_CHARS))
    tiled = tile_pairs(full.select("key", "n", "sig", "text", "root", "members", "all_chars"), tiles).drop("members", "all_chars")
    verified = keep(tiled.groupBy("root", "i", "j").applyInArrow(verify, "key long, links long, root long"), "near-verified")
    classes = keep(components(verified.select(F.col("root").alias("a"), F.col("key").alias("b"))), "near-roots")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    named = about.select("key", "first", "same", "n").join(links, "key", "left").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = keep(named, "near-named")
    heads = named.groupBy("root").agg(F.min(F.struct("first", "same")).alias("head"))
    by_text = named.join(heads, "root").select("same", F.col("head.first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"), (F.col("head.same") == F.col("same")).alias("stands"))
    out = signatures.select("key", "same").join(keep(by_text, "near-classes"), "same", "left")
    has = F.col("key").isNotNull()
    return out.select(
        F.col("key").alias(key), F.when(has, F.col("class_id")).alias("class_id"), F.when(has, F.col("n_links")).otherwise(0).alias("n_links"),
        F.when(has, F.col("n_copies")).otherwise(0).alias("n_copies"), F.coalesce(has & F.col("stands") & (F.col("key") == F.col("class_id")), F.lit(False)).alias("is_first"),
        F.lower(F.hex("same")).alias("text_md5"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class of near duplicates the row whose text and key stand for it (see `near_duplicates`); rows without a key stay.

    Where that row is repeated, the one with the least other columns stays. Columns stay as they are.
    """
    first = near_duplicates(docs, key, text).where("is_first").select(F.col(key).alias("__key"), "text_md5").distinct()
    marked = docs.withColumn("__md5", F.md5(F.coalesce(text, F.lit(""))))
    kept = marked.join(first, (F.col(key) == F.col("__key")) & (F.col("__md5") == F.col("text_md5")), "left_semi")
    order = Window.partitionBy(key, "__md5").orderBy(*(F.col(c).cast("string").asc_nulls_first() for c in docs.columns if c not in (key, text)), F.lit(0))
    kept = kept.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return kept.select(*docs.columns).union(docs.where(F.col(key).isNull()))
