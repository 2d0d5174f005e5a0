"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""
import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from panelwright.llm import bpe, fingerprints, mixing, near, pages, pii, quality, rules, substrings, toxicity
from panelwright.llm import queries as Q
from panelwright.llm.common import next_row

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# PII


def luhn_ok(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn_ok(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_equals_patterns(spark):
    r = random.Random(5)
    odd = ["", None, "a@b", "a@b.c", "x@y@z.co.uk", "é a.b+c@d-e.f. 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "+1((((((", "@@@.a@a.a", "1" * 5000, "1." * 3000, "a" * 20000 + "@", "DE89 3704 0044 0532 0130 00 bank"]
    odd += ["".join(r.choice("ab1 .@+-()49\n") for _ in range(r.randint(1, 80))) for _ in range(300)]
    got = {x.doc_id: x for x in pii.digest(pii.find_pii(frame(spark, odd))).collect()}
    for i, t in enumerate(odd):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert "iban:0:27" in got[15].spans


def test_iban_before_capital_words():
    assert [s["end"] for s in pii.scored_spans("BE68 5390 0754 7034 CASH") if s["kind"] == "iban"] == [19]
    assert pii.iban_end("BE68 5390 0754 7035 CASH") == 0


def test_pii_masks_and_keeps_columns(spark):
    d = spark.createDataFrame([(1, "mail a@b.co now", "x"), (1, "mail a@b.co now", "x"), (None, None, None)], "doc_id long, text string, spans string")
    got = sorted((str(x.text), str(x.spans)) for x in pii.mask_pii(d).collect())
    assert got == [("None", "None"), ("mail [EMAIL] now", "x"), ("mail [EMAIL] now", "x")]
    assert pii.find_pii(d.where("false")).count() == 0


# BPE


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    odd = ["", None, " ", "  ", "a  b", "a   b", " a", "a  ", "\n \n x", "foo\n \nbar", "x<|endoftext|> y  <|endoftext|>", "it's we'll I'M 12 34  é́ 日本語　 x", "a\x1cb \x1f c", "tab\t tab \tx\r\n  y", "😀 😀😀  👍🏽", "\x85 \x85a", "x" * 5000, "same", "same"]
    texts = odd + [t for _, t in docs[:120]]
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(frame(spark, ["a"]).where("false")).count() == 0


# Quality and toxicity


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    got = [r for r in quality.digest(quality.scored(docs, labels)).collect() if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id].quality for r in got) >= 0.93 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    learned = rules.train(docs, labels.where("doc_id % 3 > 0"))
    got = [r for r in rules.digest(rules.measured(docs), learned).where("doc_id % 3 = 0 AND NOT base_failed").collect() if r.doc_id in known]
    bad, good = ([r.kept for r in got if known[r.doc_id] == q] for q in (0, 1))
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.digest(toxicity.scored(docs, labels)).collect() if r.held_out and r.doc_id in known]
    found = sum(r.predicted and known[r.doc_id] for r in got)
    assert found >= 0.9 * sum(known[r.doc_id] for r in got) and found >= 0.95 * sum(r.predicted for r in got)


def test_classifiers_without_labels_or_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, None, 3.0), (2, "", 4.0), (2, "a b", 5.0)], "doc_id long, text string, score double")
    assert [r.score for r in quality.scored(d, labels).collect()] == [0.5] * 3
    assert toxicity.scored(d, labels, into="tox").count() == 3


def test_viterbi_restores_disguised_words(spark, docs):
    texts = ["you are an idiot and a stupid loser, such trash and scum"] * 300 + [t for _, t in docs]
    decoder = toxicity.Decoder(toxicity.log_model(toxicity.trigrams(frame(spark, texts))))
    assert [decoder.restore(w) for w in ("1d10t", "l0ser", "tr@sh", "$cum", "idiooot", "plain", "2.0.")] == ["idiot", "loser", "trash", "scum", "idiot", "plain", "2.0."]
    assert toxicity.restorer(decoder.cost)("an i d i o t here") == "an idiot here"


def test_viterbi_reads_runs_long_tokens_and_other_punctuation(spark, docs):
    texts = ["you are an idiot and a stupid loser, such an asshole and asshole and asshole and bitch, shit trash and scum"] * 300 + [t for _, t in docs]
    model = toxicity.log_model(toxicity.trigrams(frame(spark, texts)))
    restore = toxicity.Decoder(model).restore
    forms = {
        "a$$hole": "asshole", "b**ch": "bech", "5h17": "shit", "1d107": "idiot", "1d10t,l0ser": "idiot,loser", "tr@sh/$cum": "trash/scum", "id" + "i" * 60 + "ot": "idiot",
        "stup-id": "stupid", "st_upid": "stupid", "iddiot": "idiot", "1d10t.l0ser.tr@sh.1d10t.l0ser.tr@sh.1d10t.l0ser": "idiot.loser.trash.idiot.loser.trash.idiot.loser",
        "well-known": "well-known", "Hello": "Hello", "2024": "2024", "wow!!!": "wow!!!", "---": "---", "loser$$$": "loser$$$", "10,000.5": "10,000.5",
    }
    assert {w: restore(w) for w in forms} == forms
    of = toxicity.restorer(model)
    assert of("so -- an 1 d 1 0 t, or i.d.i.o.t ... 1 2 3 4 5") == "so -- an idiot, or idiot ... 1 2 3 4 5"
    score = toxicity.features(model)()
    assert all(set(score(w)[0]) == set(score(v)[0]) for w, v in forms.items())


def test_toxicity_reads_words_to_their_end():
    import numpy as np

    score = toxicity.features(toxicity.log_model(np.zeros(toxicity.CLASSES**3)))()
    slots = {w: set(score(w)[0]) for w in ("homophobe", "homophone", "donaudampfschiff", "donaudampfschaf")}
    assert slots["homophobe"] != slots["homophone"] and slots["homophobe"] & slots["homophone"]
    assert len(slots["donaudampfschiff"] - slots["donaudampfschaf"]) >= 4


# Rules


def test_rule_statistics_equal_brute_force(spark, docs):
    texts = ["", None, "a", "a b c a b c", "a a a a a", "x\nx\n\nx\n \ny", "\x0b \x0c"] + ["w " * 400, " ".join(str(i % 60) for i in range(500))] + [t for _, t in docs]
    got = {r.doc_id: r for r in rules.measured(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = WORD.findall(t)
        g = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        c, cover = Counter(g), set()
        for k, x in enumerate(g):
            if c[x] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)), t[:60]


def test_rules_learn_a_threshold(spark):
    d = spark.createDataFrame([(i, *[0.0] * 3, (i % 100) / 100, *[0.0] * 3, (i % 100) >= 80, i % 3 > 0) for i in range(900)], ", ".join(f"{s} double" for s in ("key", *rules.STATS)) .replace("key double", "key long") + ", bad boolean, grow boolean")
    learned = rules.learn(d)
    hit = d.where(~rules.verdict(learned)).select("bad").collect()
    assert len(hit) >= 160 and all(r.bad for r in hit)
    assert rules.learn(d.where("NOT bad")) == []


# Fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def anchors_of(text):
    """(hash, place) of runs of five words whose least word hash is at an edge."""
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall(text)]
    out = []
    for i in range(len(h) - 4):
        run, seed = h[i : i + 5], 42
        if min(run) in (run[0], run[4]):
            for x in run:
                seed = xxhash.xxh64((x & 2**64 - 1).to_bytes(8, "little"), seed=seed).intdigest()
            out.append((seed >> 32, i))
    return out or [(xxhash.xxh64(text.encode(), seed=42).intdigest() >> 32, 0)]


def positional(a, b):
    places = [{}, {}]
    for found, of in ((a, places[0]), (b, places[1])):
        for h, i in found:
            of.setdefault(h, []).append(i)
    n = near = 0
    for h in places[0].keys() & places[1].keys():
        k = min(len(p[h]) for p in places)
        n, near = n + k, near + k * (1 - abs(places[0][h][0] / (a[-1][1] + 1) - places[1][h][0] / (b[-1][1] + 1)))
    return near / (len(a) + len(b) - n)


def test_fingerprints_equal_brute_force(spark, docs):
    d = frame(spark, [t for _, t in docs])
    got = {r.doc_id: r for r in fingerprints.digest(d).collect()}
    n, texts = len(docs), [t for _, t in docs]
    for i in range(n):
        k, nxt = len(texts[i]) // 3, texts[i - 1] if i else texts[n - 1]
        e = texts[i][: len(texts[i]) - k] + nxt[:k]
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        own, changed, after = map(anchors_of, (texts[i], e, nxt))
        assert got[i].fingerprint == ",".join(f"{h:08x}:{p}" for h, p in own) and got[i].edited_fingerprint == ",".join(f"{h:08x}:{p}" for h, p in changed)
        assert got[i].near_edited == pytest.approx(positional(own, changed)) and got[i].near_next == pytest.approx(positional(own, after))
    by = {}
    for i in range(n):
        by.setdefault(texts[i], set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * n
    one = fingerprints.digest(frame(spark, [None])).collect()[0]
    assert one.near_edited == one.near_next == 1.0 and fingerprints.digest(d.where("false")).count() == 0


def test_fingerprints_see_passages_changes_and_moves(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, passage = words(8000), words(8000), words(50)
    a[3000:3050] = b[5000:5050] = passage
    changed = a[:4000] + words(12) + a[4012:]
    rows = [(a, b), (a, changed), (a, a[4000:] + a[:4000]), (a, a + a[:2000]), (a, a)]
    d = spark.createDataFrame([(i, " ".join(x), " ".join(y)) for i, (x, y) in enumerate(rows)], "k long, x string, y string")
    d = fingerprints.fingerprint(fingerprints.fingerprint(d, "x", "p"), "y", "q")
    passage, edit, swapped, repeated, same = (x.s for x in d.select("k", fingerprints.likeness(F.col("p"), F.col("q")).alias("s")).orderBy("k").collect())
    assert 0 < passage < 0.01 and 0.99 < edit < 1 and 0.4 < swapped < 0.6 and 0.6 < repeated < 0.95 and same == 1


def test_next_row_with_ties_nulls_and_ranges(spark):
    r = random.Random(7)
    rows = [(r.choice([None, r.randrange(50), r.randrange(10**6)]), f"t{i}", i) for i in range(3000)] + [(5, "same", 1), (5, "same", 1)]
    d = spark.createDataFrame(rows, "k long, text string, other long")
    got = [sorted(map(str, next_row(d, "k", ["text"], per_range=n).collect())) for n in (10, 100_000)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    chain = next_row(d.where("k > 1000").dropDuplicates(["k"]), "k", ["text", "k"], per_range=10).collect()
    order = sorted((x.k for x in chain), reverse=True)
    assert {x.k: x.next_k for x in chain} == dict(zip(order, order[1:] + order[:1]))


# Mixing


def test_mix_targets_and_sizes(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * 3 for _ in range(r.randint(0, 60))), r.choice(["b", "a", None, "z"]) if i % 3 else "hot") for i in range(3000)] + [(9000, None, "a"), (9001, "x y", "tiny")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(d).collect()}
    total, size = {}, {}
    for i, t, s in rows:
        size[i] = len(WORD.findall(t or ""))
        total[s] = total.get(s, 0) + size[i]
    order = sorted([s for s in total if s is not None]) + [None]
    w = {s: 1 + k % 3 for k, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(total.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * total[s]
            left -= want[s]
        open_ -= over
    taken = Counter()
    for i, t, s in rows:
        x = got[i]
        assert x.size == size[i] and x.source_size == total[s] and x.target == pytest.approx(want[s]) and 0 <= x.taken <= 3 * x.size
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= max(30, 0.002 * want[s]) for s in order)
    import math

    solved = {x.source: x for x in mixing.fitted(d).collect()}
    for src in order:  # the dual's optimum by bisection
        of = [size[i] for i, _, x in rows if x == src and size[i]]
        mean = total[src] / sum(x == src for _, _, x in rows)
        rate = lambda lam, z: min(3.0, math.exp(min(40, lam * z / mean)))
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(z * rate(mid, z) for z in of) < want[src] else (lo, mid)
        if want[src] < 3 * total[src]:
            assert solved[src].lam == pytest.approx(lo, abs=1e-6)
            assert all(got[i].rate == pytest.approx(rate(lo, size[i]), rel=1e-5) for i, _, x in rows if x == src and size[i])
    again = {x.doc_id: x.taken for x in mixing.mix(d.repartition(7)).collect()}
    assert again == {i: x.taken for i, x in got.items()}
    assert mixing.mix(d.where("false")).count() == 0


# Near duplicates and substrings


def shingle_set(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark, docs):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijklmnop") * 2 + str(r.randint(0, 99)) for _ in range(120)) for _ in range(6)]
    texts = [t for _, t in docs] + ["", None, "a b", "a b", " a  b "]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "zz" + str(r.randint(0, 9))
            texts.append(" ".join(w))
    got = {x.doc_id: x for x in near.near_duplicates(frame(spark, texts)).collect()}
    sets, n = [shingle_set(t) for t in texts], len(texts)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(n):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += not same
                links[b] += not same
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [(got[i].class_id, got[i].n_links) for i in range(n)] == [(find(i), links[i]) for i in range(n)]
    assert near.near_duplicates(frame(spark, ["a"]).where("false")).count() == 0


def test_near_duplicates_of_repeated_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("b", long), ("a", "quite another text"), ("a", long + " end"), ("a", long + " end"), (None, long), ("c", "quite another text"), ("d", None), ("e", "")]
    d = spark.createDataFrame([(k, t, n, 0) for n, (k, t) in enumerate(rows)], "doc_id string, text string, key int, root int")
    got = sorted((str(x.doc_id), str(x.class_id), x.n_links, x.n_copies, x.is_first) for x in near.near_duplicates(d).collect())
    assert got == sorted([("b", "a", 1, 0, False), ("a", "a", 1, 0, True), ("a", "a", 1, 0, True), ("a", "a", 0, 1, True), ("c", "a", 0, 1, False), ("None", "None", 0, 0, False), ("d", "d", 0, 1, True), ("e", "d", 0, 1, False)])
    kept = sorted((str(x.doc_id), x.text, x.key) for x in near.one_of_each(d).collect())
    assert kept == [("None", long, 4), ("a", "quite another text", 1), ("a", long + " end", 2), ("d", None, 6)]


def test_least_matches_bound():
    least = near.least_matches()
    assert list(least) == list(range(16, 129, 16)) and all(least[n] < 0.8 * n for n in least)


def test_tiles_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 8)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:i] + ["x" + str(i)] + words[i + 1 :]) for i in range(40)]
    got = near.near_duplicates(frame(spark, texts)).collect()
    assert all(x.class_id == 0 and x.n_links == 39 for x in got)


def test_substrings_equal_brute_force(spark, docs):
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(33))
    texts = [t for _, t in docs] + ["", None, "a " * 50, "a b " * 40, "  x y " * 12, passage, passage + " end", "start " + passage, " ".join(f"p{i}" for i in range(19))]
    texts += [" ".join(r.choice("ab") for _ in range(300)) for _ in range(5)]
    got = {x.doc_id: x for x in substrings.dedup(frame(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - 19):
            g = tuple(ws[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        x = got[i]
        assert (x.n_words, x.n_removed, x.kept) == (len(ws), sum(gone), b" ".join(w for w, d in zip(ws, gone) if not d).decode()), i
        assert sum(gone) == sum(f.n_words for f in x.factors) and all(a.start + a.n_words <= b.start for a, b in zip(x.factors, x.factors[1:]))
        for f in x.factors:  # the reference is earlier and says the same
            of = (texts[f.of] or "").encode().split()
            assert of[f.at : f.at + f.n_words] == ws[f.start : f.start + f.n_words] and (f.of, f.at) < (i, f.start)
    rows = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    assert [x.n_removed for x in substrings.dedup(rows).collect()] == [0, 0, 0]


# Pages


def test_lcs_matches_dynamic_programming():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = sorted(pages.shared(a, b))
        it = iter(b)
        assert len(got) == t[-1][-1] and all(any(y == a[i] for y in it) for i in got)


def test_pages(spark):
    menu = "<nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div><div>Site motto</div>"
    plain = lambda x: f"<html><body>{menu}<div>{x} &amp; more<br>text</div><p>Shared tail</body>"
    rows = [
        (1, "https://h.org/a/1", plain("One")), (2, "https://h.org/a/2", plain("Two")), (3, None, None), (4, "x", ""),
        (5, "https://g.org/1", f"<body>{menu}<article><header><h1>T&eacute;st</h1></header><p>Same <b>bold</b>  words<p>Next<form>f</form><section class=comments><p>hi</p></section></article><footer>&copy;</footer>"),
        (6, "https://g.org/2", f"<body>{menu}<article><p>Same <b>bold</b> words</p><script>x='</p>'</script></article></body>"), (7, "https://solo.org/", "<p>a < b &lt; c<!-- no --></p><div"),
    ]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One & more text", 2: "Two & more text", 3: "", 4: "", 5: "Tést\n\nSame bold words\n\nNext", 6: "Same bold words", 7: "a < b < c"}


def test_pages_keep_what_neighbours_share(spark):
    menu, foot = "<div>Motto of the site</div>", "<div>All rights reserved</div>"
    words = lambda i: f"{i} is told at length in this paragraph, which no other page of the host has"
    plain = lambda *x: f"<body>{menu}{''.join(f'<div>{y}</div>' for y in x)}{foot}</body>"
    inside = lambda i, *x: f"<body>{menu}<article><p>{words(i)}</p>{''.join(f'<ul><li>{y}</li></ul>' for y in x)}</article></body>"
    story = plain(words("One"), words("Two"), words("Three"))
    rows = [
        (1, "https://a.org/story", story), (2, "https://a.org/story?print=1", story), (3, "https://a.org/story?x", plain(words("One"), words("Two"), "changed")),
        (4, "https://b.org/x/1", plain(words("Four"), "A quotation", words("Five"))), (5, "https://b.org/x/2", plain(words("Six"), "A quotation", words("Seven"))),
        (6, "https://c.org/1", inside("Eight", "Salt", "Pepper")), (7, "https://c.org/2", inside("Nine", "Salt", "Sugar")),
        (8, "https://d.org/1", inside("A", "Share this")), (9, "https://d.org/2", inside("B", "Share this")), (10, "https://d.org/3", inside("C", "Share this")),
    ]
    got = {r.page_id: r.text.split("\n\n") for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(words(w) in got[i] for i in (1, 2) for w in ("One", "Two", "Three")) and words("One") in got[3] and "changed" in got[3]
    assert got[4] == [words("Four"), "A quotation", words("Five")] and got[5] == [words("Six"), "A quotation", words("Seven")]
    assert got[6] == [words("Eight"), "Salt", "Pepper"] and got[7] == [words("Nine"), "Salt", "Sugar"]
    assert got[9] == [words("B")] and got[8] == [words("A"), "Share this"]


def test_page_neighbours_do_not_depend_on_ranges(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    a, b = ({r.page_id: (r.text, r.n_shared) for r in pages.extract(p, per_range=n).collect()} for n in (7, 10_000))
    assert a == b and pages.extract(p.where("false")).count() == 0


# Registered queries and the pipeline


def test_registered_names():
    assert [n.split("_")[0] for n in Q.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = C.keep_quality(spark, docs, SF)
    scores = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3} and kept.columns == docs.columns
    one = C.drop_near_duplicates(spark, docs, SF)
    classes = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values())) and one.columns == docs.columns
    odd = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "other words", None, None, 11), (None, None, None, None, None)], docs.schema)
    assert C.drop_near_duplicates(spark, odd, SF).count() == 3
    for _, stage in C.STAGES:
        assert stage(spark, odd, SF).count() >= 1 and stage(spark, odd.where("false"), SF).count() == 0
    masked = {r.doc_id: r for r in C.mask_personal_data(spark, docs, SF).collect()}
    assert all(r.n_chars == len(r.text) and not base_spans(r.text) for r in masked.values())
    mixed = Counter(r.doc_id for r in C.mix_sources(spark, docs, SF).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert C.encode(spark, docs, SF).count() == docs.count() and [n for n, _ in C.STAGES][0] == "quality classifier"


def test_substrings_ship_deflated_texts():
    """Texts that go over the network are deflated and come back as they were."""
    import pyarrow as pa

    from panelwright.llm import substrings

    texts = ["the cat sat on the mat " * 40, "", None, "über \U0001f600\x00"]
    made = next(substrings.packed(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["key", "text"])])))
    assert substrings.unpacked(made.column("text")).to_pylist() == texts and len(made.column("text")[0].as_py()) < 100
