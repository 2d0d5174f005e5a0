"""Learned and paired operators against plain Python: the classifier's updates and scores, the decision list, Viterbi paths, pages, the pipeline."""
import itertools
import math
import random

import numpy as np
import pytest

from panelwright.llm import linear, pages, pii, quality, rules, toxicity

SF = "/root/testdata/sf0.001"


def hash_order(spark, ids):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}


def ftrl(rows, epochs, alpha, beta, l1):
    """Follow the regularised leader, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)

    for _ in range(epochs):
        for y, slots, values in rows:
            at = [*slots, "bias"]
            x = [*values, 1.0]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            new_z, new_n = {}, {}
            for i, wi, xi in zip(at, w, x):
                g = (p - y) * xi
                new_z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * wi
                new_n[i] = n.get(i, 0.0) + g * g
            z |= new_z
            n |= new_n
    return weight


def test_quality_scores_equal_plain_updates(spark):
    r = random.Random(8)
    good, bad = "alpha beta gamma delta epsilon zeta".split(), "buy now cheap win click free".split()
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(r.randint(3, 30)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, score long, label string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i < 50] + [(3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    out = quality.scored(docs, labels)
    got = {x.doc_id: x.score for x in out.collect()}
    learn = [i for i, _ in rows if i < 50 and __import__("zlib").crc32(str(i).encode()) % 5]
    order = hash_order(spark, learn)
    of, texts = quality.features(), dict(rows)
    fit = []
    for i in sorted(learn, key=order.get):
        slots, values = of(texts[i] or "")
        # A slot that two features share is updated once, by the later one, as in the operator's arrays.
        fit.append((i % 2, slots.tolist(), values.astype("<f4").astype(float).tolist()))
    if any(len(set(s)) < len(s) for _, s, _ in fit):
        pytest.skip("features collide")
    weight = ftrl(fit, 4, 0.5, 0.1, 0.02)
    for i, t in rows:
        slots, values = of(t or "")
        dot = sum(weight(s) * v for s, v in zip(slots.tolist(), values.tolist())) + weight("bias")
        assert got[i] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-5)
    assert set(out.columns) == {"doc_id", "text", "score", "label"} and quality.scored(docs.where("false"), labels).count() == 0


def test_classifiers_with_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "other words here"), (None, "good words"), (2, "bad words !!")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        first, again = ([(str(x.doc_id), x.held_out, x.score) for x in module.digest(module.scored(d, labels)).orderBy("doc_id", "score").collect()] for d in (docs, docs.repartition(5)))
        assert first == again and len(first) == 8 and all(h is False for k, h, _ in first if k == "None")


def test_calibration_fits_a_logistic_curve():
    r = np.random.default_rng(2)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(2.0 * x + 0.7)))).astype(float)
    slope, shift = linear.calibration(x, y)
    assert slope == pytest.approx(2.0, abs=0.2) and shift == pytest.approx(0.7, abs=0.15)
    assert linear.calibration(x, np.zeros(4000)) == (1.0, 0.0)


def test_viterbi_equals_enumeration(spark):
    words = ["idiot", "ass", "kill", "bitch", "loser", "shit", "plain", "letter", "ball"]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words * 40)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.log_model(toxicity.trigrams(d)))
    price = decoder.price

    def lm(s):
        c = [0, 0, *map(toxicity.char_class, s), 0]
        return sum(price[a << 12 | b << 6 | x] for a, b, x in zip(c, c[1:], c[2:]))

    def options(c, n):
        """(string, cost) of a run of n times c that is no digit."""
        if c.isalpha():
            out = [(c * min(n, 2), toxicity.SHORTENS * max(0, n - 2))]
            return out + ([(c, toxicity.HALVES if n == 2 else toxicity.SHORTENS * (n - 1))] if n > 1 else [])
        out = [(x * k, toxicity.IMITATES * n + (toxicity.SHORTENS if k < n else 0)) for x in toxicity.LEET.get(c, "") for k in {1, min(n, 2)}]
        if n == 2 and len(toxicity.LEET.get(c, "")) == 2:
            out += [(x, toxicity.IMITATES * n) for x in (toxicity.LEET[c], toxicity.LEET[c][::-1])]
        if c in toxicity.SEPARATORS:
            return out + [("", toxicity.DROPS * n if n < 3 else toxicity.DROPS), (c * n, 0.0)]
        return out + [(c * n, toxicity.KEEPS * n)]

    for seen in ("a$$", "k!!l", "b!tch", "b!!tch", "iddiot", "st_p", "l@ser", "sh!!t", "p-l-a", "lettter", "a$$ball", "k!!lss", "idi@t"):
        groups = [(k, len(list(g))) for k, g in itertools.groupby(seen)]
        best = min((sum(c for _, c in path) + lm("".join(s for s, _ in path)) for path in itertools.product(*(options(*g) for g in groups))))
        made = decoder.viterbi(seen)
        assert any("".join(s for s, _ in path) == made and sum(c for _, c in path) + lm(made) == pytest.approx(best, abs=1e-4) for path in itertools.product(*(options(*g) for g in groups))), seen
        if seen.isalpha():
            assert decoder.runs(seen) == made


def test_disguises_are_restored(spark):
    words = "you are an idiot and a stupid loser bitch kill ass moron clown and trash".split() + ["asshole"] * 6
    d = spark.createDataFrame([(i, " ".join(words)) for i in range(400)], "doc_id long, text string")
    of = toxicity.restorer(toxicity.log_model(toxicity.trigrams(d)))
    for seen, meant in (("a$$hole", "asshole"), ("k!!l", "kill"), ("b!!tch", "bitch"), ("a$$", "ass"), ("i__d__i__o__t", "idiot"), ("1d10t,l0ser;tr@sh/m0ron", "idiot,loser;trash/moron")):
        assert of(seen) == meant


def test_decision_list_equals_plain_search(spark):
    """Sequential covering with the same cuts, by counting rows one by one."""
    r = random.Random(6)
    rows = []
    for i in range(1200):
        stats = [float(r.randint(0, 40)), r.random() * 8, r.random(), r.random(), r.random(), r.random(), r.random()]
        rows.append((*stats, bool(stats[4] > 0.8 or stats[2] > 0.85 and stats[0] < 30), i % 3 > 0))
    d = spark.createDataFrame(rows, ", ".join(f"{s} double" for s in rules.STATS) + ", bad boolean, grow boolean")
    cuts = {s: sorted(set(d.selectExpr(f"percentile_approx({s}, array({', '.join(str(i / rules.BINS) for i in range(1, rules.BINS))}), 10000) AS c").first().c)) for s in rules.STATS}
    at = {s: k for k, s in enumerate(rules.STATS)}
    holds = lambda row, c: row[at[c[0]]] >= c[2] if c[1] == ">=" else row[at[c[0]]] < c[2]
    left, want = rows, []
    while len(want) < rules.MAX_RULES:
        grow, prune = [x for x in left if x[-1]], [x for x in left if not x[-1]]
        if sum(x[-2] for x in grow) < rules.LEAST_COVER:
            break
        rule, some = [], grow
        while len(rule) < rules.MAX_CONDITIONS:
            p0 = sum(x[-2] for x in some)
            if not p0:
                break
            base, found = math.log2(p0 / len(some)), []
            for s in rules.STATS:
                for cut in cuts[s]:
                    for op in ("<", ">="):
                        c = (s, op, cut)
                        hit = [x for x in some if holds(x, c)]
                        p = sum(x[-2] for x in hit)
                        if p and c not in rule:
                            found.append((round(p * (math.log2(p / len(hit)) - base), 6), -rules.STATS.index(s), c, p / len(hit)))
            top = max(found, default=None)
            if top is None or top[0] <= 0:
                break
            rule.append(top[2])
            some = [x for x in some if holds(x, top[2])]
            if top[3] >= 0.999:
                break
        if not rule:
            break
        score = []
        for k in range(1, len(rule) + 1):
            hit = [x for x in prune if all(holds(x, c) for c in rule[:k])]
            p = sum(x[-2] for x in hit)
            score.append(((2 * p - len(hit)) / max(1, len(hit)), -(k - 1), p, len(hit)))
        best = max(score, key=lambda x: x[:2])
        if best[2] < rules.LEAST_COVER / 2 or best[2] / best[3] < rules.PRECISION:
            break
        rule = rule[: 1 - best[1]]
        want.append(rules.tightest(rule))
        left = [x for x in left if not all(holds(x, c) for c in rule)]
    assert want and rules.learn(d) == want
    gone = d.withColumn("kept", rules.verdict(want)).collect()
    assert all(x.kept == (not any(all(holds(tuple(x), c) for c in rule) for rule in want)) for x in gone)


def test_rules_without_labels_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "w", 2), (1, "a b c", "w", 2), (None, None, None, None)], "doc_id long, text string, __w string, n_words int")
    got = rules.measured(docs)
    assert set(docs.columns) <= set(got.columns) and sorted(r.n_words for r in got.collect()) == [0, 3, 3] and [r["__w"] for r in got.where("doc_id IS NOT NULL").collect()] == ["w", "w"]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.train(docs, empty) == [] and rules.digest(got, []).where("kept").count() == 0 and rules.measured(docs.where("false")).count() == 0


# Pages


def lcs(a, b):
    """Every place of `a` in one longest common subsequence, the last one that a walk from the end finds."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_pages_equal_pairing_by_hand(spark):
    """Neighbours by host and path, each page judged beside them in plain Python."""
    import re

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    extra = "<body><div>Motto</div>{}<div>Imprint</div></body>"
    rows += [(10_000 + i, f"https://plain.org/a/{i % 7}", extra.format(f"<div>Story {i} is told at length here</div><div>It ends {i} times</div>")) for i in range(12)] + [(20_000, None, None), (20_000, None, "<p>x</p>")]
    d = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, lines string")
    got = sorted((r.page_id, r.text, r.n_chars, r.n_shared, r.n_named) for r in pages.extract(d, per_range=5).collect())

    def key(row):
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", row[1] or "")
        return (m[1].lower() if m else "", m[2] if m else "", str(row[0]).rjust(20, "0"))

    made = []
    for row in rows:
        lines, kinds = pages.lines_of(row[2] or "")
        host, path, k = key(row)
        made.append({"id": row[0], "host": host, "path": path, "lines": lines, "kinds": kinds, "hashes": pages._hashes(lines), "sort": ("\x01".join((host, path, k)), pages._hashes(lines))})
    made.sort(key=lambda p: p["sort"])
    want = []
    for i, p in enumerate(made):
        near = [made[j] for j in (i - 1, i + 1) if 0 <= j < len(made) and made[j]["host"] == p["host"]]
        for q in near:
            assert len(pages.shared(p["hashes"], q["hashes"])) == lcs(p["hashes"], q["hashes"])
        text, gone, named = pages.main_text(p, near)
        want.append((p["id"], text, len(text), gone, named))
    assert got == sorted(want) and sum(w[3] for w in want if w[0] >= 10_000) >= 20


def test_pages_lose_no_article_text(spark):
    one = {
        "<article><p>A</p><button>Share<p>B</p><p>C</p></article>": "A\n\nB\n\nC", "<article><p>A</p><button>Share</button><p>B</p></article>": "A\n\nB",
        "<article class='social-policy'><p>Body</p></article>": "Body", "<div class='ad-banner'>Buy</div><article><p>x <math>1+1</math> y</p><svg><p>z</p></article>": "x 1+1 y\n\nz",
        "<article><p>a<script>var x='<p>'</script> b</p><select><option>1</select></article><div class=comments>c</div>": "a b", "<main><p>" + "long " * 20000 + "</p></main>": ("long " * 20000).strip(),
        "<body><article><p>A<aside>B</aside></p><div class='share-buttons'>C</div><p>D</article><footer>E": "A\n\nD",
    }
    d = spark.createDataFrame([(i, f"https://h{i}.org/", h) for i, h in enumerate(one)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(d).collect()}
    assert [got[i] for i in range(len(one))] == list(one.values())


# Pipeline


def test_pipeline_equals_stages_by_hand(spark):
    """run() on the smallest tables: survivors of the threshold, one of each class, masked, copied, encoded."""
    import hashlib
    from collections import Counter

    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from panelwright.llm import bpe, mixing, near

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, SF).collect())
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id: r for r in quality.scored(docs, labels).where("score >= 0.3").collect()}
    sets = {i: near.shingles(next(iter(near.WordHashes().of(__import__("pyarrow").array([r.text]))))) for i, r in kept.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(kept)
    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if kept[a].text == kept[b].text or len(x) and len(y) and 5 * len(both := np.intersect1d(x, y)) >= 4 * (len(x) + len(y) - len(both)):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    first = [i for i in ids if find(i) == i]

    def masked(t):
        out, at = [], 0
        for s in pii.scored_spans(t):
            if s["start"] >= at:
                out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join(out) + t[at:]

    texts = {i: masked(kept[i].text) for i in first}
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame([(i, t, kept[i].source) for i, t in texts.items()], "doc_id long, text string, source string")).collect()}
    tok = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for i, t in texts.items():
        if copies[i]:
            e = tok.encode(t, add_special_tokens=False).ids
            want[i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()] += copies[i]
    assert got == want
