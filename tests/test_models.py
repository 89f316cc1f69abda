import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import splits
from riskframe.plans import calibrate, explain, models, score
from riskframe.sources import records


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((f"s{i}", i // 2, y, float(rng.normal(y, 1)), float(rng.normal(0, 1)), float(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "sample_id string, item_idx long, label int, n_chars double, n_words double, n_sentences double")
    return records.stored(splits.with_split(df), "data")


COLUMNS = ["n_chars", "n_words", "n_sentences"]


@pytest.fixture(scope="module")
def boosted(data):
    return models.fit_boosted(data, COLUMNS, 42, maxIter=5, maxDepth=3, stepSize=0.3)


def test_attributions_add_up(data, boosted):
    scored = models.predict(boosted, data)
    impacts = explain.tree_attributions(scored, boosted, COLUMNS)
    for r in scored.join(impacts, "sample_id").limit(50).collect():
        margin = r.base_value + sum(r.impacts)
        assert r.prob == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)


def test_attributions_are_shapley_values(boosted):
    leaves = explain.leaves_of(boosted)
    x = np.random.default_rng(0).normal(0, 1, (5, 3))
    phi, _ = explain.leaf_attributions(x, leaves)

    def worth(row, known):
        total = 0.0
        for value, path in leaves:
            for f, share, splits_ in path:
                value *= all((row[f] <= t) == left for t, left in splits_) if f in known else share
            total += value
        return total

    for row, got in zip(x, phi):
        for f in range(3):
            others = [k for k in range(3) if k != f]
            want = sum(
                math.factorial(n) * math.factorial(2 - n) / 6 * (worth(row, {*s, f}) - worth(row, set(s))) for n in range(3) for s in itertools.combinations(others, n)
            )
            assert got[f] == pytest.approx(want, abs=1e-9)


def test_bundle_round_trip(data, boosted, tmp_path):
    models.save_bundle(str(tmp_path / "b"), boosted, COLUMNS, {"maxIter": 5})
    model, columns, params = models.load_bundle(str(tmp_path / "b"))
    assert (columns, params) == (COLUMNS, {"maxIter": 5})
    a, b = (models.predict(m, data).agg(F.sum("prob")).first()[0] for m in (boosted, model))
    assert a == pytest.approx(b)


def test_calibration(data, boosted):
    scored = models.predict(boosted, data)
    rows = calibrate.compare(scored.filter("split = 'val'"), scored.filter("split = 'test'")).collect()
    assert {r.method for r in rows} == {"raw", "platt", "isotonic"} and all(0 <= r.value <= 1 for r in rows)


def test_forest_and_logistic(data):
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    for pipe in (models.logistic(COLUMNS, train.count()), models.forest(COLUMNS, 1, trees=5, depth=3)):
        assert models.predict(pipe.fit(train), test).agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] > 0.6


def test_random_params_are_distinct():
    points = models.random_params(30)
    assert len({tuple(sorted(p.items())) for p in points}) == 30 and points == models.random_params(30)


def test_validation(spark):
    rows = [("1", "q", "c", "a"), ("2", "q", "c", "   "), ("3", "q", "c", None), ("4", "q" * 5001, "c", "a")]
    df = spark.createDataFrame(rows, "sample_id string, question string, context string, answer string")
    assert {r.sample_id: r.reason for r in score.rejected(df).collect()} == {"2": "answer blank", "3": "answer missing", "4": "question too long"}
    assert score.accepted(df).count() == 1
