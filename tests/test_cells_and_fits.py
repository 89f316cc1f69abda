import itertools
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics, perturb, stats
from riskframe.plans import calibrate, models
from riskframe.sources import unified


@pytest.mark.parametrize("n", [1, 4, 10, 57, 3000])
def test_draws_are_poisson(spark, n):
    """Counts of draws against the distribution, by chi-squared over cells of at least 20."""
    total = 4000
    rows = spark.range(total).select(F.lit(n).alias("n"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("own"))
    draws = np.array([r.w for r in rows.select(F.expr(stats.poisson_sql("n", "own")).alias("w")).collect()])
    assert draws.mean() == pytest.approx(n, abs=4 * math.sqrt(n / total)) and draws.var() == pytest.approx(n, rel=0.12)
    share = lambda k: math.exp(k * math.log(n) - n - math.lgamma(k + 1))
    cells, left, seen = [], 0.0, 0
    for k in range(int(n + 12 * math.sqrt(n) + 20)):
        left, seen = left + total * share(k), seen + int((draws == k).sum())
        if left >= 20:
            cells.append((left, seen))
            left, seen = 0.0, 0
    chi = sum((s - e) ** 2 / e for e, s in cells)
    assert chi < len(cells) + 5 * math.sqrt(2 * len(cells))


def test_bootstrap_counts_cells_once(spark):
    """A thousand rows of one score cost one cell; intervals are near those of plain resampling."""
    rng = np.random.default_rng(5)
    rows = [(float(s), int(rng.random() < s)) for s in rng.choice([0.1, 0.3, 0.6, 0.9], 1200)]
    df = spark.createDataFrame([(s, y, int(s >= 0.5)) for s, y in rows], "prob double, label int, pred int")
    got = {r.metric: (r.low, r.high) for r in stats.bootstrap(df, 400).collect()}
    assert got == {r.metric: (r.low, r.high) for r in stats.bootstrap(df.repartition(3), 400).collect()}
    scores, labels = (np.array(x) for x in zip(*rows))
    f1 = []
    for _ in range(400):
        w = rng.poisson(1, len(rows))
        p = scores >= 0.5
        f1.append(2 * w[p & (labels == 1)].sum() / (2 * w[p & (labels == 1)].sum() + w[p != (labels == 1)].sum()))
    assert got["f1"] == pytest.approx(tuple(np.quantile(f1, [0.025, 0.975])), abs=0.012)


def test_signed_ranks_against_enumeration():
    rng = random.Random(1)
    for n in (1, 5, 12, 15):
        sizes = sorted(rng.randint(1, 6) for _ in range(n))
        ranks = [int(2 * (sizes.index(s) + 1 + (sizes.count(s) - 1) / 2)) for s in sizes]
        for w in (0, 3, sum(ranks) // 3, sum(ranks) // 2):
            whole = sum(sum(itertools.compress(ranks, signs)) <= w for signs in itertools.product((0, 1), repeat=n))
            assert stats.at_most(ranks, w) == whole / 2**n


def test_exact_wilcoxon_beyond_twenty(spark):
    pairs = [(float(i) if i % 3 else -float(i), 0.0) for i in range(1, 41)]
    row = stats.wilcoxon(spark.createDataFrame(pairs, "a double, b double")).first()
    w = sum(i for i in range(1, 41) if i % 3 == 0)
    assert (row.n, row.w) == (40, w) and row.p == pytest.approx(2 * stats.at_most([2 * i for i in range(1, 41)], 2 * w))


def test_mcnemar_by_group(spark):
    rows = [("x", 1, 1, 0)] * 6 + [("x", 1, 0, 1), ("y", 1, 1, 1), (None, 0, 0, 1)]
    got = {r.g: r for r in stats.mcnemar(spark.createDataFrame(rows, "g string, label int, pred_a int, pred_b int"), by=["g"]).collect()}
    assert (got["x"].b, got["x"].c) == (6, 1) and got["x"].p == pytest.approx(math.erfc(math.sqrt(16 / 7 / 2)))
    assert got["y"].p == 1.0 and (got[None].b, got[None].c) == (1, 0)


def newton(x, y):
    a, b = 0.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-(a + b * x)))
        h = q * (1 - q)
        step = np.linalg.solve([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]], [(y - q).sum(), ((y - q) * x).sum()])
        a, b = a + step[0], b + step[1]
    return a, b


def test_recalibration_against_plain_fits(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, shift, slope, n in (("a", 0.5, 2.0, 300), ("b", -1.0, 0.4, 200), ("few", 0.0, 1.0, 12), (None, 0.0, 1.0, 50)):
        x = rng.normal(0, 1.2, n)
        y = rng.random(n) < 1 / (1 + np.exp(-(shift + slope * x)))
        rows += [(g, float(1 / (1 + np.exp(-v))), int(t)) for v, t in zip(x, y)]
    rows += [("one", 0.2 + i / 100, 1) for i in range(40)] + [("parted", 0.1 + 0.8 * (i % 2), i % 2) for i in range(40)]
    got = {r.g: r for r in metrics.recalibration(spark.createDataFrame(rows, "g string, prob double, label int"), "g").collect()}
    assert set(got) == {"a", "b", "few", "one", "parted"} and got["few"].pooled and not got["a"].pooled
    for name in ("a", "b", "few"):
        part = rows if name == "few" else [r for r in rows if r[0] == name]
        p, y = np.array([r[1] for r in part]), np.array([r[2] for r in part])
        assert (got[name].intercept, got[name].slope) == pytest.approx(newton(np.log(p / (1 - p)), y), abs=1e-6)
    assert got["one"].slope is None and got["parted"].slope is None


def test_swaps_leave_no_match_as_it_was(spark):
    rng = random.Random(2)
    texts = [" ".join(str(rng.randint(1, 9)) if rng.random() < 0.6 else "w" for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "no figures", "3", "10% of 2.5!"]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sample_id string, answer string")
    from riskframe.functions.text import NUMBER

    rows = perturb.swapped(df, NUMBER).collect()
    assert sorted(rows) == sorted(perturb.swapped(df.repartition(3), NUMBER).collect())
    find = lambda t: __import__("re").findall(r"\b\d+(?:\.\d+)?%?\b", t or "")
    new = {r.sample_id: r.answer for r in rows}
    for i, text in enumerate(texts):
        old, now = find(text), find(new[f"s{i}"])
        assert len(old) == len(now) and all(a != b for a, b in zip(old, now))
        assert (text is None) == (new[f"s{i}"] is None)
    every = lambda ts: sorted(x for t in ts for x in find(t))
    assert every(texts) == every(new.values())
    alone = spark.createDataFrame([("a", "7 7"), ("b", "7 8")], "sample_id string, answer string")
    assert every(r.answer for r in perturb.swapped(alone, NUMBER).collect()) == ["7", "7", "7", "8"]


def test_mapping_report(spark):
    df = spark.createDataFrame([("1", "x", None, 5), (None, "y", 1, None)], "id string, body string, mark int, extra int")
    how = unified.Mapping("s", {"sample_id": F.col("id"), "answer": F.col("body"), "label": F.col("mark")}, ("id", "body", "mark"))
    got = {r.column: (r.mapped, r.defaulted, r.dropped) for r in unified.mapping_report(df, how).collect()}
    assert got["sample_id"] == (1, 1, 0) and got["answer"] == (2, 0, 0) and got["task"] == (0, 2, 0) and got["extra"] == (0, 0, 1) and len(got) == 11
    row = unified.unified(df, how).filter("answer = 'y'").first()
    assert (row.source, row.sample_id, row.task, row.label, row.spans, row.generator) == ("s", None, "other", 1, [], "unknown")


def test_fits_overlap_and_keep_their_order(spark):
    barrier = threading.Barrier(2, timeout=60)

    def task(i):
        barrier.wait()
        return spark.range(i)

    import functools

    assert [df.count() for df in models.concurrently([functools.partial(task, i) for i in range(4)], 2)] == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def split_rows(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 2).cast("int").alias("label"), F.expr("case when id % 10 < 6 then 'train' when id % 10 < 8 then 'val' else 'test' end").alias("split"))
    return rows.withColumn("x", F.col("label") + F.pmod(F.xxhash64("sample_id"), F.lit(100)) / 60).withColumn("noise", F.pmod(F.xxhash64(F.lit(1), "sample_id"), F.lit(100)) / 100)


def test_calibration_over_seeds(spark, split_rows):
    """F1, ECE and Brier of raw probabilities against plain values, for each seed; gains are differences within a seed."""
    out = calibrate.over_seeds(split_rows, ["x", "noise"], (1, 2), maxIter=4, maxDepth=2, subsamplingRate=0.7).collect()
    got = {(r.method, r.metric, r.seed): r.value for r in out}
    assert len(got) == 18
    for seed in (1, 2):
        scored = models.predict(models.fit_boosted(split_rows, ["x", "noise"], seed, maxIter=4, maxDepth=2, subsamplingRate=0.7), split_rows.filter("split = 'test'")).collect()
        p, y = np.array([r.prob for r in scored]), np.array([r.label for r in scored])
        bins = np.minimum(9, (p * 10 + 1e-9).astype(int))
        ece = sum(abs(y[bins == b].mean() - p[bins == b].mean()) * (bins == b).mean() for b in set(bins))
        f1 = 2 * ((p >= 0.5) & (y == 1)).sum() / ((p >= 0.5).sum() + y.sum())
        assert [got["raw", m, seed] for m in ("f1", "ece", "brier")] == pytest.approx([f1, ece, ((p - y) ** 2).mean()])
    gains = {(r.method, r.metric, r.seed): r.gain for r in stats.calibration_gain(spark.createDataFrame(out)).collect()}
    assert gains["platt", "ece", 2] == pytest.approx(got["platt", "ece", 2] - got["raw", "ece", 2]) and len(gains) == 12
