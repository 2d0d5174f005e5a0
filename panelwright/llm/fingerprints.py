"""Document fingerprints from closed syncmers of words, with DataFrame operations only.

Every word gets a hash. A run of K words is chosen if the smallest of its word hashes is its first or
its last word's: that depends on the run alone, so the same passage gives the same anchors
wherever it stands, and every stretch of a text has some (about two fifths of all runs). The
fingerprint is the list of all anchors of the whole text in order of place, each as eight hex
digits of its hash, a colon and its place (the number of the run's first word), joined by commas.

`likeness` matches anchors by position. Of an anchor that both texts hold, as many occurrences
are matched as both have; a match counts 1 minus the distance of the two first places, each
taken as a share of its text, so passages that moved count for less. Matches are divided by the anchors
of both texts less those matched: 1 for equal fingerprints, 0 without a common anchor. Nothing
is sampled, so short and long texts are compared alike.

A text without anchors (fewer than K words, or none chosen) has one anchor, its whole text's
hash, at place 0. Equal texts have equal fingerprints; null texts count as empty. Repeated rows
are rows of their own. Very long texts cost time and memory in proportion, but for one sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, next_row, text_or_empty, words_of

K = 5
#: Bits of a place: a text in Spark has fewer than 2**30 words.
PLACE = 30


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def anchors(text: Column, k: int = K) -> Column:
    """array<bigint>: the text's closed syncmers in order of place, repeats included: 32 bits of hash, then the place."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    hashed = lambda x: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x), 32), PLACE)

    def chosen(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: F.slice(h, i, k))
        picked = F.transform(runs, lambda r, i: F.when(F.array_min(r) == F.least(F.get(r, 0), F.get(r, k - 1)), hashed(r) + i).otherwise(F.lit(-1).cast("long")))
        return F.filter(picked, lambda x: x >= 0)

    found = let(hashes, lambda h: F.when(F.size(h) >= k, chosen(h)))
    return let(found, lambda f: F.when(F.coalesce(F.size(f), F.lit(0)) > 0, f).otherwise(F.array(hashed(text))))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, PLACE))), 8, "0"), F.lit(":"), _place(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors that two fingerprints have in common, matched by position."""
    side = lambda x: F.shiftright(x, PLACE).bitwiseAND(F.lit(1).cast("long"))
    # Both texts' anchors sorted by hash, then text, then place: equal hashes stand together.
    of = lambda found, n: F.transform(found, lambda x: F.shiftleft(F.shiftrightunsigned(x, PLACE), PLACE + 1) + F.lit(n << PLACE).cast("long") + _place(x))
    end = lambda found: (_place(F.element_at(found, -1)) + 1).cast("double")

    def matched(m: Column) -> Column:
        hash_at = lambda i: F.shiftrightunsigned(F.get(m, i), PLACE + 1)
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (hash_at(i) != hash_at(i - 1)))
        runs = let(starts, lambda s: F.transform(s, lambda at, j: F.slice(m, at + 1, F.coalesce(F.get(s, j + 1), F.size(m)) - at)))
        both = F.filter(runs, lambda r: (F.size(r) > 1) & (side(F.get(r, 0)) == 0) & (side(F.element_at(r, -1)) == 1))

        def worth(r: Column) -> Column:
            def of_counts(n: Column) -> Column:
                apart = F.abs(_place(F.get(r, 0)) / end(a) - _place(F.get(r, n)) / end(b))
                return F.struct(F.least(n, F.size(r) - n).cast("double").alias("n"), (F.least(n, F.size(r) - n) * (1.0 - apart)).alias("near"))

            return let(F.size(F.filter(r, lambda x: side(x) == 0)), of_counts)

        return F.transform(both, worth)

    total = lambda w, c: F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x[c])
    found = let(F.sort_array(F.concat(of(a, 0), of(b, 1))), matched)
    return let(found, lambda w: total(w, "near") / (F.size(a) + F.size(b) - total(w, "n")))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "anchors", k: int = K) -> DataFrame:
    """`docs` with the text's anchors in `into`; all rows and other columns stay, a column of that name is replaced."""
    return docs.withColumn(into, anchors(text_or_empty(F.col(text)), k))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, text, next_text, edited) of every row: the last third of each text replaced by the start of the next document's, descending by key (after the last: the first).

    Keys are numbers; null ones come last, equal ones in the order of a hash of their texts. Other columns are dropped.
    """
    d = docs.select(F.col(key).alias("key"), text_or_empty(F.col(text)).alias("text"))
    d = next_row(d, "key", ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    changed = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 3) as int))"))
    return d.select(F.col("key").alias(key), "n_chars", "text", "next_text", F.when(third > 0, changed).otherwise(F.col("text")).alias("edited"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the registered query returns, from documents."""
    d = edited(docs)
    for column, into in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        d = fingerprint(d, column, into)
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
