"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates r of documents minimise sum(r log r - r) under one token constraint per source,
sum(size * r) = target, and r <= cap. The solution is r = min(cap, exp(lambda * size / mean size of
the source)); `solve` finds each source's lambda by Newton iterations on the convex dual, kept
inside a bracket, until every source's words are within `TOLERANCE` of its target. They run on the counts
of documents by (source, size), which is all the dual depends on. Rates become copies by a hash
of the document's key and text: floor(rate + u + shift), where u is uniform in [0, 1) and the source's shift,
narrowed over a grid, brings the words taken to within `CLOSE` of the
target, or as near as the step of one document allows; then one document's copies change by one where that is nearer. Nothing depends on partitions or time.

Null texts have size 0 and take nothing; null sources are a source of their own, the last;
repeated rows are documents of their own, and rows with equal keys and texts are copied alike, so a source
made of a few texts repeated can only come as near its target as their sizes allow. Keys may be null.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, text_or_empty

CAP = 3.0
#: Shares of its target by which a source's expected words and its words taken may miss it; the grid of one narrowing pass; bits of the hash.
TOLERANCE, CLOSE, GRID, BITS = 1e-9, 1e-3, 32, 40


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of the text."""
    return F.regexp_count(text_or_empty(F.col(text)), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, get `weights` in turn and share the total size; a target
    stops at `cap` times its source's size and the excess is reshared by weight. Sorted by
    cap / weight the capped sources are a prefix, so running sums find the final level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row per source from here on: the windows below see sources, never documents.
    by = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double"))
    per = per.withColumn("limit", cap * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight)
    per = per.withColumn("capped", F.col("limit") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.least("limit", level * F.col("weight")))
    return per.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(40.0), F.greatest(F.lit(-700.0), lam * z))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def solve(sized: DataFrame, per_source: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """source, lam, mean, n_docs, source_size, target: Newton on the dual of each source.

    Words taken grow with lambda, so every step shortens a bracket; each third step halves it, so
    the loop ends whatever the sizes. Where the target is the cap times the size (or 0), lam is so
    large (or small) that every rate is the cap (or 0).
    """
    counts = keep(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    state = per_source.withColumn("mean", F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1)))
    full, none = F.col("target") >= cap * F.col("source_size"), F.col("target") <= 0
    state = keep(state.withColumns({"lam": F.when(none, F.lit(-1e9)).when(full, F.lit(1e9)).otherwise(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "open": ~(none | full)}), "mix-sources")
    z, step = F.col("size") / F.col("mean"), 0
    while state.where("open").limit(1).count():
        tilted = counts.alias("c").join(state.where("open").alias("s"), _same("c.source", "s.source")).select("s.source", "n", "size", z.alias("z"), _rate(F.col("lam"), z, cap).alias("r"))
        words = F.col("n") * F.col("size") * F.col("r")
        sums = tilted.groupBy("source").agg(F.sum(words).alias("got"), F.sum(F.when(F.col("r") < cap, words * F.col("z")).otherwise(0.0)).alias("slope"))
        both = state.alias("s").join(sums.alias("g"), _same("s.source", "g.source"), "left").select("s.*", "got", "slope")
        below = F.col("got") < F.col("target")
        lo, hi = F.when(below, F.col("lam")).otherwise(F.col("lo")), F.when(~below, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi)) & F.lit(step % 3 < 2)
        # Else: double away from 0 while an end is open, or halve.
        away = F.when(hi.isNull(), F.greatest(lo * 2, F.lit(1.0))).when(lo.isNull(), F.least(hi * 2, F.lit(-1.0))).otherwise((lo + hi) / 2)
        near = (F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")) | (hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)))
        done = ~F.col("open") | F.col("got").isNull() | F.coalesce(near, F.lit(False))
        state = both.select("source", "source_size", "n_docs", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(away).alias("lam"), lo.alias("lo"), hi.alias("hi"), (~done).alias("open"))
        state, step = keep(state, "mix-newton"), step + 1
    return state.drop("lo", "hi", "open")


def _copies(rate: Column, u: Column, shift: Column, cap: float) -> Column:
    return F.least(F.lit(int(cap)), F.greatest(F.lit(0), F.floor(rate + u + shift))).cast("long")


def _uniform(key: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("mix"), key, text), F.lit(1 << BITS)) / float(1 << BITS)


def fitted(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per source: source, source_size, target, mean, lam, shift; all that a document's copies depend on besides itself."""
    sized = keep(docs.select(F.col(source).alias("source"), sizes(docs, text).alias("size"), _uniform(F.col(key), F.col(text)).alias("u")), "mix-sizes")
    solved = keep(solve(sized, targets(sized, weights, cap), cap), "mix-solved")
    rated = sized.where("size > 0").alias("d").join(solved.alias("s"), _same("d.source", "s.source"))
    rated = keep(rated.select("d.source", "size", "u", _rate(F.col("lam"), F.col("size") / F.col("mean"), cap).alias("rate")), "mix-rates")
    shifts, width = solved.select("source", "target", "mean", F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(None).cast("double").alias("shift")), 2.0
    while shifts.where("shift IS NULL").limit(1).count():
        at = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * (k / GRID)
        tried = rated.alias("d").join(shifts.where("shift IS NULL").alias("s"), _same("d.source", "s.source"))
        sums = tried.groupBy("s.source").agg(F.array(*(F.sum(F.col("size") * _copies(F.col("rate"), F.col("u"), at(k), cap)) for k in range(GRID + 1))).alias("got"))
        both = shifts.alias("s").join(sums.alias("g"), _same("s.source", "g.source"), "left").select("s.*", "got")
        # The last shift that takes no more than the target, and the next one.
        below = F.greatest(F.size(F.filter("got", lambda g: g <= F.col("target"))) - 1, F.lit(0))
        above = F.least(below + 1, F.lit(GRID))
        lo, hi = at(below), at(above)
        miss = lambda k: F.abs(F.get("got", k) - F.col("target"))
        best = F.when(miss(above) < miss(below), hi).otherwise(lo)
        width /= GRID
        found = F.coalesce(F.col("shift"), F.when(F.col("got").isNull(), 0.0).when((F.least(miss(below), miss(above)) <= CLOSE * F.col("target")) | F.lit(width < 2.0**-BITS), best))
        shifts = keep(both.select("source", "target", "mean", lo.alias("lo"), hi.alias("hi"), found.alias("shift")), "mix-shifts")
    # One document's copy more or less, where that brings the source nearer: of all documents the one whose size fits best.
    now = rated.alias("d").join(shifts.alias("h"), _same("d.source", "h.source")).select("d.source", "u", "size", "target", _copies(F.col("rate"), F.col("u"), F.col("shift"), cap).alias("copies"))
    left = now.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"))
    alike = now.groupBy("source", "u", "size", "copies").agg(F.count(F.lit(1)).alias("n"))
    change = F.when(F.col("left") > 0, F.when(F.col("copies") < int(cap), 1)).otherwise(F.when(F.col("copies") > 0, -1))
    tried = alike.alias("a").join(left.alias("l"), _same("a.source", "l.source")).select("a.source", "u", "size", "left", change.alias("more"), F.abs(F.col("left") - change * F.col("n") * F.col("size")).alias("miss"))
    best = tried.where("miss < abs(left)").groupBy("source").agg(F.min(F.struct("miss", "u", "size", "more")).alias("best"))
    out = solved.alias("s").join(shifts.alias("h"), _same("s.source", "h.source")).join(best.alias("b"), _same("s.source", "b.source"), "left")
    return keep(out.select("s.source", "source_size", "s.target", "s.mean", "lam", "shift", "best"), "mix-fitted")


def copied(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with size, source_size, target, rate, copies and taken; all rows and other columns stay, columns of these names are replaced.

    Documents are not shuffled: what they need of their source is joined to them, one row a source.
    """
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    per = fitted(docs, weights, cap, key, text, source).select(F.struct("*").alias("__per"))
    d = docs.withColumns({"__u": _uniform(F.col(key), F.col(text)), "__size": sizes(docs, text)}).drop(*made)
    d = d.join(per, F.col(source).eqNullSafe(F.col("__per.source")))
    rate = F.when(F.col("__size") > 0, _rate(F.col("__per.lam"), F.col("__size") / F.col("__per.mean"), cap)).otherwise(0.0)
    d = d.withColumns({"size": F.col("__size"), "source_size": F.col("__per.source_size"), "target": F.col("__per.target"), "rate": rate})
    one = F.when((F.col("__u") == F.col("__per.best.u")) & (F.col("size") == F.col("__per.best.size")), F.col("__per.best.more")).otherwise(0)
    d = d.withColumn("copies", F.when(F.col("size") > 0, _copies(F.col("rate"), F.col("__u"), F.col("__per.shift"), cap) + F.coalesce(one, F.lit(0))).otherwise(0).cast("long"))
    return d.withColumn("taken", F.col("size") * F.col("copies")).drop("__u", "__size", "__per")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, rate, copies, taken) of every row of `docs`."""
    return copied(docs.select(key, text, source), weights, cap, key, text, source).select(key, "size", "source_size", "target", "rate", "copies", "taken")
