"""Quality rules: a decision list learned by sequential covering, with DataFrame operations only.

`measured` computes a text's statistics. `learn` grows conjunctions of thresholds on the labelled
rows' statistics, one at a time: each adds the condition that raises FOIL's gain most on two thirds
of the rows not yet covered, is pruned from its end on the other third, and joins the list if
it is precise enough there; the rows it covers are then set aside. Only counts by (statistic,
bin) reach the driver. `verdict` is the list as one ordered CASE expression.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, let, text_or_empty, words_of

SYMBOLS = "[#*$%&|<>]"
#: What rules may test. Ratios of an empty text are 0.
STATS = ("n_words", "mean_letters", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "lines_per_word")
BINS, MAX_RULES, MAX_CONDITIONS, PRECISION, LEAST_COVER, SAMPLE = 64, 8, 3, 0.98, 10, 20_000


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows, in order."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _places(g: Column) -> Column:
    """Sorted places of the windows that are found twice or more."""
    def repeated(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

    # A few repeated windows are looked up one by one, many by sorting all windows with their places.
    def few(d: Column) -> Column:
        return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(-1)), lambda i: i >= 0)

    def many(p: Column) -> Column:
        at = lambda k: F.get(p, k)["g"]
        twice = F.filter(p, lambda x, k: ((k > 0) & (x["g"] == at(k - 1))) | ((k + 1 < F.size(p)) & (x["g"] == at(k + 1))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def of(d: Column) -> Column:
        placed = lambda: F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) > 48, let(placed(), many)).otherwise(few(d))

    distinct = F.size(F.array_distinct(g)) == F.size(g)
    return F.when(distinct, F.array().cast("array<int>")).otherwise(let(let(F.sort_array(g), repeated), of))


def _covered(at: Column) -> Column:
    """Words in the windows at these sorted places: each covers the words up to the next place, three at most."""
    return let(at, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, i: n + 3) - F.aggregate(F.transform(p, lambda i, k: F.when(k > 0, F.greatest(F.lit(0), F.get(p, k - 1) + 3 - i)).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios in STATS.

    Null texts count as empty, with 0 everywhere; columns of these names are replaced, all rows and other columns
    stay. Windows are told apart by 64-bit hashes of their three words. Long texts cost time in
    proportion, but for sorting their windows.
    """
    t = text_or_empty(F.col(text))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    blank = lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")) > 0

    # One nested expression, so that a filter on a result never multiplies the steps before it.
    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _covered(let(_windows(w), _places)).cast("long").alias("n_repeat_words"), let(F.filter(F.split(t, "\n", -1), blank), of_lines).alias("lines"), F.regexp_count(t, F.lit("[A-Z]")).alias("upper"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def of_counts(c: Column) -> Column:
        ratios = {
            "mean_letters": over(c["word_chars"] - c["n_symbols"], c["n_words"]), "symbol_share": over(c["n_symbols"], c["word_chars"]), "dup_line_share": over(c["lines"]["dup"], c["lines"]["n"]),
            "repeat_share": over(c["n_repeat_words"], c["n_words"]), "upper_share": over(c["upper"], c["word_chars"]), "lines_per_word": over(c["lines"]["n"], c["n_words"]),
        }
        counts = [c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols")] + [c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words")]
        return F.struct(*counts, *(x.alias(name) for name, x in ratios.items()))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS[1:])
    d = docs.withColumn("__stats", let(let(words_of(F.col(text)), of_words), of_counts))
    return d.withColumns({n: F.col("__stats")[n] for n in names}).drop("__stats")


Condition = tuple[str, str, float]


def condition(c: Condition) -> Column:
    stat, op, at = c
    return F.col(stat) >= at if op == ">=" else F.col(stat) < at


def holds(rule: list[Condition]) -> Column:
    out = condition(rule[0])
    for c in rule[1:]:
        out = out & condition(c)
    return out


def tightest(rule: list[Condition]) -> list[Condition]:
    """The rule without conditions that another one on the same statistic implies."""
    best: dict[tuple[str, str], float] = {}
    for stat, op, at in rule:
        best[stat, op] = max(best.get((stat, op), at), at) if op == ">=" else min(best.get((stat, op), at), at)
    return [(stat, op, at) for (stat, op), at in best.items()]


def _bin(stat: str, cuts: list[float]) -> Column:
    """How many of the cuts are at most the statistic."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(stat))) if cuts else F.lit(0)


def _best(rows: DataFrame, cuts: dict[str, list[float]], taken: list[Condition]) -> tuple[Condition, float] | None:
    """The condition of greatest FOIL gain on `rows` (bad, bins), from the counts of each statistic's bins."""
    long = rows.select("bad", F.explode(F.arrays_zip(F.array(*map(F.lit, STATS)).alias("stat"), F.col("bins").alias("bin"))).alias("x"))
    counts: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in STATS}
    for r in long.groupBy("x.stat", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():
        counts[r.stat][r.bin] = (r.p, r.n)
    some = next(iter(counts.values()))
    p0, n0 = (sum(c[i] for c in some.values()) for i in (0, 1))
    if not p0:
        return None
    base, found = math.log2(p0 / (p0 + n0)), []
    for s in STATS:
        p, n = 0, 0
        for k, cut in enumerate(cuts[s]):
            dp, dn = counts[s].get(k, (0, 0))
            p, n = p + dp, n + dn
            for op, a, b in (("<", p, n), (">=", p0 - p, n0 - n)):
                if a and (s, op, cut) not in taken:
                    found.append((round(a * (math.log2(a / (a + b)) - base), 6), -STATS.index(s), (s, op, cut), a / (a + b)))
    top = max(found, default=None)
    return None if top is None or top[0] <= 0 else top[2:]


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that marks a text as bad. `labelled` has STATS, a boolean `bad` and a boolean `grow` (two thirds); rules may be none."""
    rules: list[list[Condition]] = []
    found = labelled.select(*(F.percentile_approx(s, [i / BINS for i in range(1, BINS)], 10_000).alias(s) for s in STATS)).first()
    cuts = {s: sorted(set(found[s] or [])) for s in STATS}
    left = keep(labelled.withColumn("bins", F.array(*(_bin(s, cuts[s]) for s in STATS))), "rules-bins")
    while len(rules) < MAX_RULES:
        grow, prune = left.where("grow"), left.where("NOT grow")
        if grow.where("bad").limit(LEAST_COVER).count() < LEAST_COVER:
            break
        rule: list[Condition] = []
        rows = grow
        while len(rule) < MAX_CONDITIONS and (found := _best(rows, cuts, rule)):
            rule.append(found[0])
            rows = rows.where(condition(found[0]))
            if found[1] >= 0.999:
                break
        if not rule:
            break
        # Pruning: the prefix of the rule with the best (p - n) / (p + n) on the rows held back, the shortest of equals.
        tests = [x for k in range(1, len(rule) + 1) for x in (F.count_if(holds(rule[:k]) & F.col("bad")), F.count_if(holds(rule[:k]) & ~F.col("bad")))]
        got = prune.agg(F.array(*tests).alias("c")).first().c
        worth = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k) for k in range(len(rule))]
        size = 1 - max(worth)[1]
        p, n = got[2 * size - 2], got[2 * size - 1]
        if p < LEAST_COVER / 2 or p / (p + n) < PRECISION:
            break
        rules.append(tightest(rule[:size]))
        left = left.where(~holds(rule[:size]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """False where a rule of the list holds, tried in order, else true."""
    out = F.lit(True)
    for k, rule in enumerate(rules):
        out = F.when(holds(rule), F.lit(False)) if not k else out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else out


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, key: str = "doc_id") -> list[list[Condition]]:
    """Rules from labels.quality = 0 of at most `limit` labelled documents, those of least key hash."""
    rows = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(key), key).limit(limit)
    known = measured(docs.select(key, "text").join(F.broadcast(rows), key))
    known = known.select(*(F.col(s).cast("double").alias(s) for s in STATS), (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("grow"), key), F.lit(3)) > 0).alias("grow"))
    return learn(keep(known, "rules-stats"))


def digest(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The columns that the registered query returns, from doc_id and the statistics."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(rules)).alias("kept"))
