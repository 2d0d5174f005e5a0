"""Substring dedup by relative Lempel-Ziv factors against all documents.

Words are runs of code points other than space and \\x09-\\x0D. A document is parsed from left to right
into factors: each is the longest stretch, of `window` words or more, that follows the first earlier occurrence
(smaller key, or the same document, earlier start) of its first window word for word, and carries
that place. The reference is every document, indexed in two levels:

1. Seeds. Each window has a minimal 8-word gram, the same one wherever the window occurs. Only
   windows whose minimal gram occurs at least twice in the corpus can be repeats; seeds are
   about a seventh of the words, counted with partial sums and joined back by gram.
2. Blocks. A block of documents is factored against its own index first; for each window
   that it holds it asks the other blocks once, with the window's 96-bit hash, so a passage
   that a third of all documents hold is one row per block, not one per document.

Windows across the boundary of two factors are windows like any other and are looked up
themselves, so where a factor's reference breaks off, the next factor takes over at that
word if a window around the boundary starts earlier somewhere else: together factors are exactly
the words that earlier windows cover. All counts are exact but for hash collisions (2**-96 for a pair of windows).

Keys are integers. Null texts have no words. Other columns are not returned. Rows with equal keys are one document, treated alike; rows with a null
key are left as they are and are no reference. Texts of fewer than `window` words stay whole.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep
from .wordhash import A, WordHashes, grams, mixed

#: Words of a window and of a seed; a window has at most 32 seeds.
WINDOW, GRAM = 20, 8
#: Multipliers of the second hash of windows.
B = [np.uint64(pow(0xC2B2AE3D27D4EB4F, 1 << i, 1 << 64)) for i in range(6)]


def running_minima(v: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values, from those of 1, 2, 4, ... values."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if size < n else v


def minima(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the hash of its minimal gram (59 bits, above 5 of 0), that gram's place (mod 32), and whether the window has it twice."""
    v = mixed(grams(h, gram, A)) & ~np.uint64(31)
    place = np.arange(len(v), dtype=np.uint64) & np.uint64(31)
    low, high = (running_minima(v | p, window - gram + 1) for p in (place, np.uint64(31) - place))
    return low & ~np.uint64(31), low & np.uint64(31), (low & np.uint64(31)) != np.uint64(31) - (high & np.uint64(31))


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("of", pa.int64()), ("at", pa.int32())]))
RUNS_SQL = "array<struct<start:int,n:int,of:long,at:int>>"


def breaks(s: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each window (start, key and start of its reference) does not follow on the one before it."""
    return np.append(True, (np.diff(s) != 1) | (np.diff(of) != 0) | (np.diff(at) != 1))


def factors_of(runs: pa.StructArray, window: int) -> list[dict]:
    """The greedy parse from the windows that start earlier: a factor ends where its reference breaks off, the next one begins there."""
    start, n, of, at = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "of", "at"))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, of, at = np.repeat(start, n) + step, np.repeat(of, n), np.repeat(at, n) + step
    order = np.argsort(start, kind="stable")
    start, of, at = start[order], of[order], at[order]
    new = np.flatnonzero(breaks(start, of, at))
    out, done = [], 0
    for s, k, key, ref in zip(start[new].tolist(), np.diff(new, append=len(start)).tolist(), of[new].tolist(), at[new].tolist()):
        end, begin = s + k + window - 1, max(s, done)
        if end > begin:
            out.append({"start": begin, "n_words": end - begin, "of": key, "at": ref + begin - s})
            done = end
    return out


def packed(batches):
    """Batches of (key, text) with each text deflated: texts go over the network once, and words of prose take less than half the room."""
    for b in batches:
        texts = pa.array([None if t is None else zlib.compress(t.encode(), 1) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("key"), texts], ["key", "text"])


def unpacked(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.decompress(t).decode() for t in texts.to_pylist()], pa.string())


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept, factors) of every row: the kept words joined by one space, and the factors as (start, n_words, of, at): places in the text, and where the reference is."""
    gram = max(min(GRAM, window), window - 31)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def seeds(batches):
        hashes = WordHashes()
        for b in batches:
            keys, found = [], []
            for k, h in zip(b.column("key").to_pylist(), hashes.of(b.column("text"))):
                if k is not None and len(h) >= window:
                    low, at, twice = minima(h, window, gram)
                    new = np.concatenate([[True], (at[1:] != at[:-1]) | (low[1:] != low[:-1])])
                    u, n = np.unique(low[new], return_counts=True)
                    n[np.searchsorted(u, np.unique(low[twice]))] += 1
                    keys.append(np.full(len(u), k))
                    found.append((u.view(np.int64), n))
            if keys:
                cols = [np.concatenate([f[0] for f in found]), np.concatenate(keys), np.concatenate([f[1] for f in found]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["gram", "key", "n"])

    seeded = docs.mapInArrow(seeds, "gram long, key long, n int")
    # Equal keys are one document: its grams count once.
    twice = seeded.groupBy("gram").agg(F.sum("n").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.max("n").alias("m")).where("a < b OR m > 1").select("gram")
    twice = keep(twice, "dedup-grams")
    small = docs.mapInArrow(packed, "key long, text binary")
    wanted = seeded.select("gram", "key").join(twice, "gram").groupBy("key").agg(F.collect_set("gram").alias("grams"))

    def windows(batches):
        """Of each block of documents: windows to look up in other blocks, and runs of those with an earlier one in this block: start, number, key and start of the reference."""
        hashes = WordHashes()

        def block(rows):
            rows.sort(key=lambda r: r[0])
            w1, w2, doc, start = [], [], [], []
            for i, (_, h, known) in enumerate(rows):
                low, _, _ = minima(h, window, gram)
                s = np.flatnonzero(np.isin(low, known.view(np.uint64)))
                w1.append(mixed(grams(h, window, A))[s])
                w2.append((mixed(grams(mixed(h), window, B))[s] >> np.uint64(33)).astype(np.int64))
                doc.append(np.full(len(s), i))
                start.append(s)
            w1, w2, doc, start = map(np.concatenate, (w1, w2, doc, start))
            keys = np.asarray([r[0] for r in rows])
            order = np.lexsort((start, doc, w2, w1))
            a, b, d, s = w1[order], w2[order], keys[doc[order]], start[order]
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            later = (d > d[first]) | (s > s[first])
            none = pa.nulls(int(head.sum()), RUNS)
            yield pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array(b[head].astype(np.int32)), pa.array(d[head]), pa.array(s[head].astype(np.int32)), none], NAMES)
            d, s, of, at = d[later], s[later], d[first][later], s[first][later]
            if len(d):
                order = np.lexsort((s, d))
                d, s, of, at = d[order], s[order], of[order], at[order]
                new = np.flatnonzero(breaks(s, of, at) | np.append(True, d[1:] != d[:-1]))
                runs = pa.StructArray.from_arrays([pa.array(s[new].astype(np.int32)), pa.array(np.diff(new, append=len(s)).astype(np.int32)), pa.array(of[new]), pa.array(at[new].astype(np.int32))], fields=list(RUNS.value_type))
                d = d[new]
                cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                own = mixed(d[cut].view(np.uint64)).view(np.int64)  # no window's key: spreads the rows
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(d)).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(cut), -1, np.int32)), pa.array(d[cut]), pa.array(np.full(len(cut), -1, np.int32)), lists], NAMES)

        rows, size = [], 0
        for b in batches:
            some = b.filter(pa.compute.is_valid(b.column("grams")))
            for k, h, known in zip(some.column("key").to_pylist(), hashes.of(unpacked(some.column("text"))), some.column("grams")):
                rows.append((k, h, known.values.to_numpy()))
                size += len(h)
            if size > 1_500_000:
                yield from block(rows)
                rows, size = [], 0
        if rows:
            yield from block(rows)

    NAMES = ["w1", "w2", "key", "start", "runs"]
    asked = small.join(wanted, "key", "left").mapInArrow(windows, f"w1 long, w2 int, key long, start int, runs {RUNS_SQL}")
    same = W.partitionBy("w1", "w2").orderBy("key", "start")
    later = asked.withColumns({"rank": F.rank().over(same), "first": F.first(F.struct("key", "start")).over(same)}).where("runs IS NOT NULL OR rank > 1")
    one = F.struct("start", F.lit(1).alias("n"), F.col("first.key").alias("of"), F.col("first.start").alias("at"))
    later = later.groupBy("key").agg(F.collect_list(F.when(F.col("runs").isNull(), one)).alias("one"), F.flatten(F.collect_list("runs")).alias("many"))
    later = later.select("key", F.concat("one", "many").alias("runs"))

    def cut(batches):
        for b in batches:
            n_words, n_removed, kept, factors = [], [], [], []
            for t, runs in zip(unpacked(b.column("text")).to_pylist(), b.column("runs")):
                words = _words(t)
                n_words.append(len(words))
                found = factors_of(runs.values, window) if runs.is_valid and len(runs.values) else []
                left, at = [], 0
                for f in found:
                    left += words[at : f["start"]]
                    at = f["start"] + f["n_words"]
                left += words[at:]
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                factors.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("of", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, kind)], ["key", "n_words", "n_removed", "kept", "factors"])

    out = small.join(later, "key", "left").mapInArrow(cut, "key long, n_words long, n_removed long, kept string, factors array<struct<start:int,n_words:int,of:long,at:int>>")
    return out.withColumnRenamed("key", key)


def digest(df: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM later, (SELECT unnest(range(0, 20)) AS o)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
