"""Exact searches over vectors and the alignment of two tokenizers, against plain Python."""
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelwright.llm import alignment, negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank string, row int, block string"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def place(score, vec_id, row):
    return -score, vec_id is None, vec_id or 0, row


def plain_top(rows, k, every):
    kept = [(i, whole(v)) for i, v, *_ in rows if fine(v)]
    out = []
    for n, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            found = sorted((place(inner(v, w), c, m), c) for m, (c, w) in enumerate(kept) if m != n)[:k]
            out += [(q, r, c, -p[0]) for r, (p, c) in enumerate(found, 1)]
    return sorted(out, key=repr)


def plain_negatives(rows, every=100, n=5):
    kept = [(i, whole(v), y) for i, v, y, *_ in rows if fine(v) and y is not None]
    kept = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in kept]
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((*place(inner(v, w), c, m), c, z) for m, (c, w, z) in enumerate(kept) if m != a)
        for p in [s for s in scored if s[5] == y][:n]:
            ps = -p[0]
            near = [s for s in scored if s[5] != y and 80 * ps <= -100 * s[0] <= 100 * ps][:n]
            out += [(i, p[4], r, s[4], ps, -s[0]) for r, s in enumerate(near, 1)]
    return sorted(out, key=repr)


def odd_rows(seed, n=700, width=12):
    """Clusters, a vector repeated very often, repeated ids, ties, nulls, other lengths, no components."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 6]], i % 3) for i in range(n)]
    rows += [(n + i, [0.25] * width, i % 2) for i in range(300)]
    rows += [(0, [0.5] * width, 1), (0, [0.5] * width, 1), (None, [0.3] * width, 1), (None, [0.3] * width, 0), (100, None, 1), (200, [float("nan")] * width, 1)]
    rows += [(300, [None] + [0.1] * (width - 1), 2), (400, [float("inf")] * width, 1), (500, [], 1), (600, [0.5], 2), (700, [0.1] * (width + 3), None), (800, [-3.5] * width, 1)]
    return [(*x, 7, "x", 1, "b") for x in rows]


@pytest.mark.parametrize("per_block", [2048, 64])
def test_top_k_equals_plain_search(spark, monkeypatch, per_block):
    monkeypatch.setattr(vectors, "ROWS", per_block)
    monkeypatch.setattr(vectors.dealt, "__kwdefaults__", {"per_block": per_block})
    monkeypatch.setattr(vectors.cut, "__defaults__", (per_block,))
    rows = odd_rows(1)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_top(rows, 5, 50)


def test_top_k_of_few_rows_and_none(spark):
    for rows in ([], odd_rows(2)[:1], odd_rows(2)[:3], [(0, None, 1, 7, "x", 1, "b")]):
        assert sorted((tuple(x) for x in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain_top(rows, 5, 50)


def test_bounds_are_upper_bounds_and_stop_early():
    r = np.random.default_rng(3)
    m = np.concatenate([r.integers(-5, 5, (400, 8)) + c for c in r.integers(-200, 200, (5, 8))])
    pivots = topk.choose_pivots(m, 16)
    d, n2 = topk.distances(m, pivots), topk.norms(m)
    upper = topk.bounds(d, n2, d, n2)
    assert (upper >= m @ m.T).all()
    assert (upper < np.sort(m @ m.T, 1)[:, -6:-5]).mean() > 0.5  # on clustered rows most candidates need no evaluation
    block = vectors.Block({"width": 8, "kind": "int64", "matrix": m.tobytes(), "vec_id": list(range(2000)), "row": range(2000), "label": []})
    hits = topk.search(block, d, block, d, 5, np.full(2000, topk.LEAST))
    for i in (0, 399, 1200):
        want = sorted((-int(m[i] @ m[j]), j) for j in range(2000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(hits[i][0].tolist(), hits[i][1].tolist())] == want


def test_pivots_of_equal_rows_are_few():
    assert len(topk.choose_pivots(np.ones((50, 4), np.int64))) == 1


def test_residues_give_exact_signed_products():
    r = np.random.default_rng(4)
    for most, width in ((3, 2), (160, 64), (40_000, 3000), (2**28, 40)):
        a, b = r.integers(-most, most + 1, (7, width)), r.integers(-most, most + 1, (9, width))
        primes = negatives.moduli(float(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max())))
        assert math.prod(primes) > 2 * max(abs(int(x)) for x in (a.astype(object) @ b.T.astype(object)).ravel())
        assert (negatives.scores(negatives.remainders(a, primes), negatives.remainders(b, primes), primes) == a.astype(object) @ b.T.astype(object)).all()
    edge = np.asarray([[2**30, -(2**30)], [-(2**30), 2**30]])
    primes = negatives.moduli(2.0**61)
    assert negatives.scores(negatives.remainders(edge, primes), negatives.remainders(edge, primes), primes).tolist() == [[2**61, -(2**61)], [-(2**61), 2**61]]


def test_float32_products_stay_exact():
    assert negatives.DEPTH * 125 * 125 <= 1 << 24 and max(negatives.PRIMES) < 256
    a = np.full((1, 4 * negatives.DEPTH), 125)
    assert negatives.gemm(a, a, 251).item() == negatives.balanced(np.asarray(a.size * 125 * 125), 251)


@pytest.mark.parametrize("per_block", [2048, 64])
def test_negatives_equal_plain_search(spark, monkeypatch, per_block):
    monkeypatch.setattr(vectors.dealt, "__kwdefaults__", {"per_block": per_block})
    monkeypatch.setattr(vectors.cut, "__defaults__", (per_block,))
    rows = odd_rows(5)
    got = negatives.mine(negatives.mislabelled(spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert want and sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_negatives_of_few_rows_and_none(spark):
    for rows in ([], odd_rows(6)[:2], [(100, [1.0], None, 7, "x", 1, "b")]):
        assert sorted((tuple(x) for x in negatives.mine(negatives.mislabelled(spark.createDataFrame(rows, SCHEMA))).collect()), key=repr) == plain_negatives(rows)


def test_vectors_too_long_for_exact_scores_take_no_part(spark):
    rows = [(0, [1e9], 1), (50, [1.0], 1), (1, [2.0], 1), (2, [1e300], 1)]
    assert sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()) == [(50, 1, 1, 256 * 512)]


ODD = [None, "", " ", "  ", "a  b ", "▁x", "a\x00b", "<|endoftext|> x<s>", "\n \n x\t\ty ", "漢字かな 🙂🙂", "é́ü ß", "\x1c \x1d x", "z" * 3000, "ab12" * 900 + " " * 40, " lead and trail ", "one two"]


def texts(n=60):
    r = random.Random(7)
    words = ["".join(r.choice("etaoinshrdlu éç漢") for _ in range(r.randint(1, 9))) for _ in range(150)]
    return ODD + [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)] + ["one two", "one two"]


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    from panelwright.llm.bpe import default_path, pieces_of

    first, second = Tokenizer.from_file(default_path()), sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    first.encode_special_tokens = True
    said = pieces_of(default_path())
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    of, docs_with = [], Counter()
    for _, text in docs:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        xs, ys = [said[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            a, b, xs, ys = [], [], [], []
        ends = [list(np.cumsum([len(x) for x in z])) for z in (xs, ys)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        docs_with.update(links.keys())
        of.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in docs_with.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _), (a, b, groups, links) in zip(docs, of):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts = sum(links.values()), sum(n for k, n in links.items() if docs_with[k] == best[k[0]]), sum(n * docs_with[k] for k, n in links.items())
        out.append((d, len(a), len(b), len(groups), *counts, hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out), [g for *_, g, _ in of]


def test_alignment_equals_libraries_and_counting(spark):
    docs = list(enumerate(texts()))
    want, groups = plain_alignment(docs)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, pairs string, n_a int").repartition(3)
    for block in (16_000_000, 3000):
        got = alignment.linked(df, block_chars=block)
        assert got.columns == list(alignment.COLUMNS)
        assert sorted(tuple(x) for x in got.collect()) == want
    assert want[0][1:] == (0, 0, 0, 0, 0, 0, "") == want[1][1:] and want[2][1] > 0
    shown = alignment.groups(df, into="n_a")
    assert shown.columns == ["doc_id", "text", "pairs", "n_a"]
    assert {x.doc_id: [(g.a, g.b) for g in x.n_a] for x in shown.collect()} == dict(enumerate(groups))


def test_alignment_of_keyless_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two"), (3, None)], "doc_id long, text string")
    got = [tuple(x)[1:] for x in alignment.linked(df).collect()]
    assert len(got) == 4 and len(set(got)) == 2
    assert alignment.linked(df.limit(0)).collect() == []


def test_runs_equal_common_ends():
    r = random.Random(9)
    for n in [1, 2, 3, *[r.randint(1, 400) for _ in range(300)]]:
        cuts = sorted(r.sample(range(1, n + 1), r.randint(0, n - 1) if n > 1 else 0))
        a, b = (sorted({n, *(c for c in cuts if r.random() < p), *(r.randint(1, n) for _ in range(r.randint(0, 5)))}) for p in (0.98, 0.95))
        common = sorted(set(a) & set(b))
        ga, gb = alignment.runs(np.asarray(a), np.asarray(b))
        assert [a[i - 1] for i in ga.tolist()] == common == [b[j - 1] for j in gb.tolist()]


def test_groups_of_very_many_tokens_go_by_distinct_ids(monkeypatch):
    r = np.random.default_rng(10)
    a, b = r.integers(0, 9, 60).astype(np.int32), r.integers(0, 7, 50).astype(np.int32)
    ga, gb, doc = np.asarray([20, 25, 60]), np.asarray([10, 40, 50]), np.asarray([0, 0, 1])
    usual = alignment.links_of(a, b, ga, gb, doc)
    monkeypatch.setattr(alignment, "MANY", 160)
    for x, y in zip(usual, alignment.links_of(a, b, ga, gb, doc)):
        assert (x == y).all()
