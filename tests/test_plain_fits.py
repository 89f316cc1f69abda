import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics
from riskframe.plans import calibrate, explain


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(4)
    p = rng.choice(np.round(rng.random(60), 3), 400)
    y = (rng.random(400) < p**2).astype(int)
    return p, y, spark.createDataFrame([(f"s{i}", float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "sample_id string, prob double, label int")


def plain_platt(p, y):
    """Penalised logistic regression on one feature, by Newton's method; the intercept isn't penalised."""
    a = b = 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a + b * p)))
        h, g = q * (1 - q), q - y
        step = np.linalg.solve([[h.sum(), (h * p).sum()], [(h * p).sum(), (h * p * p).sum() + 1]], [g.sum(), (g * p).sum() + b])
        a, b = a - step[0], b - step[1]
    return 1 / (1 + np.exp(-(a + b * p)))


def plain_isotonic(p, y):
    """Pools of neighbours that violate the order, by score; value at each score."""
    pools = []
    for s in sorted(set(p)):
        pools.append([y[p == s].sum(), (p == s).sum(), [s]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return {s: total / n for total, n, scores in pools for s in scores}


def test_platt_against_plain_newton(raw):
    p, y, df = raw
    got = {r.sample_id: r.prob for r in calibrate.apply_platt(calibrate.fit_platt(df), df).collect()}
    assert [got[f"s{i}"] for i in range(len(p))] == pytest.approx(list(plain_platt(p, y)), abs=2e-4)


def test_isotonic_against_plain_pools(raw):
    p, y, df = raw
    want = plain_isotonic(p, y)
    got = {r.sample_id: r.prob for r in calibrate.apply_isotonic(calibrate.fit_isotonic(df), df).collect()}
    assert [got[f"s{i}"] for i in range(len(p))] == pytest.approx([want[s] for s in p], abs=1e-9)


def test_report_of_outside_scores_against_plain_values(raw):
    """All metrics of a frozen model's scores on rows that it wasn't fitted on."""
    p, y, df = raw
    row = metrics.full_report(df.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))).first()
    tp, fp, fn = ((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum()
    better = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert (row.f1, row.auroc, row.brier) == pytest.approx((2 * tp / (2 * tp + fp + fn), better, ((p - y) ** 2).mean()))
    bins = np.minimum(9, np.floor(p * 10 + 1e-9).astype(int))
    assert row.ece == pytest.approx(sum((bins == b).mean() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in set(bins)))


def test_summary_of_explanations(spark, raw):
    p, y, df = raw
    impacts = spark.createDataFrame([("s0", "a", 1.0, 0.5), ("s1", "a", 1.0, -1.5), ("s0", "b", 1.0, 0.25), ("s1", "b", 1.0, 0.0)], "sample_id string, feature string, value double, impact double")
    out = explain.summary(explain.global_importance(impacts), metrics.ece(df), metrics.brier(df), explain.three_cases(df)).collect()
    got = {(r.item, r.key): r.value for r in out}
    assert got["top_feature", "a"] == 1.0 and got["top_feature", "b"] == 0.125 and got["brier", "brier"] == pytest.approx(((p - y) ** 2).mean())
    least = lambda by: min(range(len(p)), key=lambda i: (by(p[i]), f"s{i}"))
    for case, by in (("high", lambda x: -x), ("low", lambda x: x), ("borderline", lambda x: abs(x - 0.5))):
        assert got["case", f"{case}:s{least(by)}"] == p[least(by)]
