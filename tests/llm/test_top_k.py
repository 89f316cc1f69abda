import math
import random

from pyspark.sql import functions as F

from riskframe.llm import top_k

KIND = "vec_id long, embedding array<float>, label int, score string, id long, x string"


def brute(rows, k):
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (q, x) in enumerate(whole):
        if q is not None and q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i is None, i) for other, (i, v) in enumerate(whole) if other != at)
            out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("TILE", 3), ("RUN", 17), ("HEAD", 40), ("QUERIES", 4)):
        monkeypatch.setattr(top_k, name, value)
    rng = random.Random(8)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.05 + i % 5)) for _ in range(24)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    rows += [(400, None), (420, [None] * 24), (440, [float("nan")] * 24), (460, [float("inf")] + [0.0] * 23), (480, []), (500, [1.0]), (20, rows[20][1]), (20, rows[20][1]), (20, rows[21][1]), (13, rows[13][1]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v, 0, "s", 5, "x") for i, v in rows], KIND)
    out = top_k.top_k(df, F.col("id") % 20 == 0, k=7)
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()), key=repr) == brute(rows, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "", 0, ""), (1, [2.0], 0, "", 0, "")], KIND)
    assert [(r.query_id, r.vec_id, r.score) for r in top_k.top_k(df, F.col("id") % 20 == 0).collect()] == [(0, 1, 64 * 128)]
    assert top_k.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_many_dimensions_and_large_components(spark, monkeypatch):
    """3,000 dimensions, blocks of few queries by the budget of numbers, and components of 2**27, whose scores doubles cannot hold."""
    monkeypatch.setattr(top_k, "NUMBERS", 20_000)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-9, 9)) / 64 for _ in range(3000)]) for i in range(60)]
    rows += [(100 + i, [float((1 << 27) + rng.randint(0, 3)) * (1 if k % 3 else -1) / 64 for k in range(rng.choice([8, 3000]))]) for i in range(45)]
    rows += [(120, [2.0**50, 3.0]), (121, [2.0**-1, 5.0]), (None, [2.0**21] * 9)]
    df = spark.createDataFrame([(i, v, 0, "s", 5, "x") for i, v in rows], KIND.replace("array<float>", "array<double>"))
    out = top_k.top_k(df, F.col("id") % 20 == 0, k=9).collect()
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in out), key=repr)
    want = brute(rows, 9)
    limit = int(top_k.LIMIT)
    held = lambda x: {(q, max(-limit, min(limit, s))) for q, _, _, s in x}
    assert [r for r in got if abs(r[3]) < limit] == [r for r in want if abs(r[3]) < limit] and held(got) == held(want)
