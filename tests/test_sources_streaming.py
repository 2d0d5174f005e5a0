"""Files, streams, folds and text recall on hand-made inputs."""
import datetime as dt
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from panelwright.operators import folds, text
from panelwright.sources import files
from panelwright.streaming import bars as stream


def test_binary_records_round_trip(spark, tmp_path):
    rows = [(20240102, 10050, 10100, 9990, 10000, 123456, 789, 0), (20240103, 1, 2, 1, 2, 4_000_000_000, 7, 0), (20249999, 1, 1, 1, 1, 1, 1, 0)]
    (tmp_path / "sh600000.day").write_bytes(b"".join(struct.pack("<8I", *r) for r in rows) + b"tail")
    (tmp_path / "empty.day").write_bytes(b"")
    got = files.binary_bars(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(r.symbol, str(r.trade_date), r.open, r.amount) for r in got] == [("sh600000", "2024-01-02", 100.5, 123456.0), ("sh600000", "2024-01-03", 0.01, 4e9)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"symbol": "A", "x": 1.5}\nnot json\n{"symbol": "B"}\n')
    got = {r.symbol: r.x for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "symbol string, x double").collect()}
    assert got == {"A": 1.5, "B": None}
    bar = {"trade_date": "20240102", "open": 1.0, "high": 2.0, "low": 1.0, "close": 1.5, "vol": 3.0, "amount": 4.0}
    (tmp_path / "n.json").write_text(json.dumps({"symbol": "A", "ts": {"daily": [bar, bar | {"trade_date": "20240103"}]}}))
    assert [str(r.trade_date) for r in files.nested_bars(spark, str(tmp_path / "n.json")).orderBy("trade_date").collect()] == ["2024-01-02", "2024-01-03"]


def test_normalised_numbers(spark):
    d = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "Close string")
    assert [r.close for r in files.normalised(d, {"Close": "close"}, ["close"]).collect()] == [1.5, None, None, None, None]


def test_months_are_replaced_and_new_rows_found(spark, tmp_path):
    d = spark.sql("SELECT 'A' AS symbol, explode(sequence(DATE '2024-01-30', DATE '2024-02-03')) AS trade_date")
    for _ in range(2):
        files.write_by_month(d, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 5 and files.newer(d, back.where("trade_date < DATE '2024-02-02'")).count() == 2


def test_stream_of_bars_drops_late_ticks(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "symbol string, ts timestamp, price double"
    for k, rows in enumerate([[("A", day(1, 1), 1.0), ("A", day(1, 2), 3.0)], [("A", day(9, 1), 5.0)], [("A", day(1, 3), 99.0), ("A", day(20, 1), 6.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.drain(stream.tumbling_bars(ticks), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {str(r.start)[:10]: (r.open, r.high, r.close, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == (1.0, 3.0, 3.0, 2)


def test_stream_phases_equal_batch(spark, tmp_path):
    rows = [("A", i, 0.5 + 0.5 * math.sin(i / 4), math.cos(i / 4)) for i in range(60)]
    schema = "symbol string, seq long, place double, slope double"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.drain(stream.phases(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = spark.createDataFrame(rows, schema).withColumn("trade_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("seq").cast("int")))
    want = [(r.phase, r.days) for r in folds.channel_phases(batch).orderBy("trade_date").collect()]
    assert [(r.phase, r.days) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()] == want and len({p for p, _ in want}) >= 4


def test_anomaly_join(spark):
    ticks = spark.createDataFrame([("A", 110.0), ("A", 101.0), ("B", 1.0)], "symbol string, price double")
    got = [r.state for r in stream.checked_against(ticks, spark.createDataFrame([("A", 100.0)], "symbol string, level double"), 0.02, 0.05).collect()]
    assert sorted(got) == ["normal", "normal", "severe"]


def test_strokes_of_a_zigzag(spark):
    up = [*range(0, 10), *range(10, 0, -1), *range(0, 10), 8, 7]
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), x + 1.0, float(x)) for i, x in enumerate(up)]
    got = folds.strokes(spark.createDataFrame(rows, "symbol string, trade_date date, high double, low double")).orderBy("start").collect()
    assert [r.direction for r in got] == [-1, 1] and got[0].start_price == 11.0 and got[0].end_price == 0.0


def test_recall_prefers_the_same_words(spark):
    d = spark.createDataFrame([(0, "red apple pie"), (1, "red apple pie today"), (2, "blue sky"), (3, None)], "doc_id long, text string")
    q = d.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    for f in (text.bm25, text.tfidf_cosine, text.jaccard):
        assert f(d, q).orderBy("rank").first().doc_id == 1
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [-1.0, 0.0])], "doc_id long, v array<float>")
    got = text.cosine(v, v.where("doc_id = 0").selectExpr("doc_id AS query_id", "v AS q")).collect()
    assert [(r.doc_id, r.rank) for r in got] == [(1, 1)] and got[0].score == pytest.approx(0.993884, abs=1e-5)


def test_tfidf_equals_reference_definition(spark):
    import math
    import re
    from collections import Counter

    texts = ["a", "A", "ab", " a\tb\n", "the cat sat", "thecat sat down", "Die Käse\u00a0reibe", "käsereibe", "b", "", None, "a\x1cb c", "😀x", "x 😀"]

    def grams(t):
        t = re.sub(r"\s+", "", (t or "").lower())
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))

    tf = [grams(t) for t in texts]
    df = Counter(g for c in tf for g in c)
    vectors = []
    for c in tf:
        v = {g: k / sum(c.values()) * (math.log((len(texts) + 1) / (df[g] + 1)) + 1) for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({g: x / norm for g, x in v.items()})
    want = {(i, j): sum(x * b.get(g, 0.0) for g, x in a.items()) for i, a in enumerate(vectors) for j, b in enumerate(vectors) if i != j and a.keys() & b.keys()}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in text.tfidf_cosine(d, d.withColumnRenamed("doc_id", "query_id"), n=100).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def recalled(spark, f, monkeypatch, share):
    """`f` on blocks of a few texts with copies, ties, empty and missing texts and a missing id, beside a plain loop; and that pairs that share a term are no rows."""
    monkeypatch.setattr(text, "TILE", 7)
    monkeypatch.setattr(text, "CHARS", 150)
    words = ["the", "of", "Cat", "sat", "mat", "über", "x1", "zebra"]
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9)) for i in range(60)] + ["the cat", "The, cat!", "the cat", "the cat", "the cat", "the cat", "the cat", "", None, "unique"]
    rows = [*enumerate(texts), (None, "the cat sat")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = d.where("doc_id % 5 = 0 OR doc_id IS NULL").withColumnRenamed("doc_id", "query_id")
    made = f(d, q, 4)
    assert "JoinInner,(term" not in made._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    scores = share([(i, t or "") for i, t in rows])
    for i in range(0, len(texts), 5):
        want = sorted((-round(s, 6), j) for j in range(len(texts)) if j != i and (s := scores(i, j)) > 0)[:4]
        got = [(-r.score, r.doc_id) for r in made.where(f"query_id = {i}").orderBy("rank").collect()] if i in (0, 60, 65) else None
        assert got is None or [(j, pytest.approx(s, abs=2e-6)) for s, j in want] == [(j, s) for s, j in got]
    assert made.where("query_id IS NULL OR doc_id IS NULL").count() == 0


def _bags(rows):
    import re
    from collections import Counter

    return [Counter(w for w in re.split(r"[^\w]+", t.lower()) if w) for _, t in rows]


def test_bm25_in_blocks(spark, monkeypatch):
    import math

    def share(rows):
        bags = _bags(rows)
        n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
        df = {w: sum(w in b for b in bags) for b in bags for w in b}
        idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        return lambda i, j: sum(idf(w) * bags[j][w] * 2.5 / (bags[j][w] + 1.5 * (0.25 + 0.75 * sum(bags[j].values()) / mean)) for w in bags[i] if w in bags[j])

    recalled(spark, text.bm25, monkeypatch, share)


def test_tfidf_in_blocks(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    def share(rows):
        flat = [re.sub(r"\s", "", t.lower()) for _, t in rows]
        bags = [Counter(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)) for t in flat]
        df = Counter(g for b in bags for g in b)
        vectors = [{g: k * (math.log((len(bags) + 1) / (df[g] + 1)) + 1) for g, k in b.items()} for b in bags]
        norms = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
        return lambda i, j: sum(x * vectors[j].get(g, 0.0) for g, x in vectors[i].items()) / norms[i] / norms[j]

    recalled(spark, lambda *a: text.tfidf_cosine(*a), monkeypatch, share)
    d = spark.createDataFrame([(0, "abcde"), (1, "abcdx"), (2, "zz")], "doc_id long, text string")
    assert [r.doc_id for r in text.tfidf_cosine(d, d.where("doc_id = 0").withColumnRenamed("doc_id", "query_id"), sizes=(4,)).collect()] == [1]


def test_jaccard_in_blocks(spark, monkeypatch):
    def share(rows):
        sets = [set(b) for b in _bags(rows)]
        return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0

    recalled(spark, text.jaccard, monkeypatch, share)


def test_floors_of_first_blocks(spark, monkeypatch):
    """Most blocks put out only what reaches the score that a query has found before, not their own best ones; the rows are those of a plain loop."""
    import math
    import random
    from collections import Counter

    r = random.Random(3)
    bags = [[f"w{int(300 ** r.random())}" for _ in range(r.randint(3, 40))] for _ in range(600)]
    monkeypatch.setattr(text, "CHARS", 2000)
    seen, real = [], text.best
    monkeypatch.setattr(text, "best", lambda scored, *a, **b: seen.append(scored) or real(scored, *a, **b))
    d = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bags)], "doc_id long, text string")
    made = text.bm25(d, d.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 3)
    got = {(x.query_id, x.rank): (x.doc_id, x.score) for x in made.collect()}
    n_blocks, n_queries = sum(map(lambda b: len(" ".join(b)), bags)) // 2000, 30
    assert n_blocks > 20 and seen[-1].count() < n_blocks * n_queries * 4 / 2
    mean, df = sum(map(len, bags)) / len(bags), Counter(w for b in bags for w in set(b))
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for q in range(0, len(bags), 20):
        scores = [(-round(sum(idf[w] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(b) / mean)) for w, c in Counter(b).items() if w in bags[q]), 6), i) for i, b in enumerate(bags) if i != q]
        want = sorted(x for x in scores if x[0] < 0)[:3]
        assert [got[q, k + 1][0] for k in range(len(want))] == [i for _, i in want] and all(abs(got[q, k + 1][1] + s) < 2e-6 for k, (s, _) in enumerate(want))


def test_floors_of_first_blocks_for_ngrams(spark, monkeypatch):
    import random

    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.randint(2, 12)))) for i in range(300)]
    monkeypatch.setattr(text, "CHARS", 500)
    seen, real = [], text.best
    monkeypatch.setattr(text, "best", lambda scored, *a, **b: seen.append(scored) or real(scored, *a, **b))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    made = text.tfidf_cosine(d, d.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 3)
    n_blocks = sum(len(t.replace(" ", "")) for _, t in rows) // 500
    assert made.count() == 45 and n_blocks > 10 and seen[-1].count() < n_blocks * 15 * 4 / 2


def test_cosine_in_blocks(spark, monkeypatch):
    """Beside SQL on odd vectors; every query beside every vector is no row."""
    import random

    import duckdb

    from panelwright.queries import ORACLE_SQL

    monkeypatch.setattr(text, "TILE", 3)
    r = random.Random(5)
    v = [[r.gauss(0, 1) for _ in range(8)] for _ in range(90)]
    v[7:12] = [v[0]] * 5
    v[20], v[21], v[22], v[23], v[24], v[25], v[40] = None, [], [None] * 8, [0.0] * 8, [None, *v[0][1:]], v[0][:5], [float("nan")] * 8
    d = spark.createDataFrame(list(enumerate(v)), "doc_id long, v array<float>")
    made = text.cosine(d, d.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "v AS q"))
    assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, x] for i, x in enumerate(v)])
    shown = lambda rows: sorted((q, rank, i, "nan" if x != x else round(x, 5)) for q, i, x, rank in rows)
    want, got = shown(con.execute(ORACLE_SQL["tx03_cosine"]).fetchall()), shown((x.query_id, x.doc_id, x.score, x.rank) for x in made.collect())
    assert got == want
