import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice(["river", "stone", "cloud", "and", "the"]) for _ in range(rng.randint(5, 60))]
        if bad := i % 4 == 0:
            words = [w + rng.choice(["%%%", "###"]) for w in words]
        rows.append((i, " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_rows(labelled):
    out = quality.judged(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")).join(labelled.select("doc_id", "quality"), "doc_id").toPandas()
    held = out[out.held_out]
    assert 0 < len(held) < len(out) and (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_null_empty_and_extra_columns(spark, labelled, docs):
    out = quality.judged(docs, labelled.select("doc_id", "quality"))
    assert out.columns == [*docs.columns, "held_out", "score", "predicted"]
    assert out.count() == docs.count() and out.filter("score is null").count() == 0


def test_clashing_names(spark, labelled):
    df = labelled.select("doc_id", "text", F.lit("mine").alias("score"), F.lit(7).alias("held_out"), F.lit("p").alias("Predicted_"), F.lit(1).alias("_text"))
    out = quality.judged(df, labelled.select("doc_id", "quality"))
    assert out.columns == [*df.columns, "held_out_", "score_", "predicted"]
    assert {(r.score, r.held_out, r.Predicted_) for r in out.collect()} == {("mine", 7, "p")}
    assert quality.accepted(df, labelled.select("doc_id", "quality")).columns == df.columns


def test_nothing_is_lost_between_pieces(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["so", "so", "SO", "x1", "(a)", "--", "\n\n", "b?!"]) for _ in range(400)).encode()
    seen = np.zeros(1 << quality.BITS, bool)
    whole = quality.features(text, seen)
    for bytes_at_a_time, words in ((1, 1), (7, 3), (64, 50)):
        monkeypatch.setattr(quality, "TEXT_PIECE", bytes_at_a_time)
        monkeypatch.setattr(quality, "WORD_PIECE", words)
        assert quality.features(text, seen).tolist() == whole.tolist() and not seen.any()


def plain_scores(texts, y, train, cost=1.0):
    """Margins of a plain classifier of the same kind: word indicators times log-count ratios, dual coordinate descent."""
    words = {w: k for k, w in enumerate(sorted({w for t in texts for w in t.lower().split()}))}
    rows = [np.array(sorted(words[w] for w in set(t.lower().split())), int) for t in texts]
    counts = np.ones((2, len(words)))
    for x, label, fit in zip(rows, y, train):
        if fit:
            counts[label, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[x] / np.sqrt(max((ratio[x] ** 2).sum(), 1e-12)) for x in rows]
    sign, alpha, w, b = 2.0 * y - 1, np.zeros(len(rows)), np.zeros(len(words)), 0.0
    for _ in range(30):
        for i in np.flatnonzero(train):
            x, v = rows[i], values[i]
            new = min(max(alpha[i] - (sign[i] * (w[x] @ v + b) - 1) / (v @ v + 1), 0), cost)
            w[x] += (new - alpha[i]) * sign[i] * v
            b += (new - alpha[i]) * sign[i]
            alpha[i] = new
    return np.array([w[x] @ v + b for x, v in zip(rows, values)])


def test_against_a_plain_classifier(spark):
    """On labelled rows of the given tables that are held out of both fits: ranked as well as by plain word indicators, to 0.01."""
    sf = "/root/testdata/sf0.01"
    if not Path(sf).is_dir():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs, labels, keep=["doc_id", "text"]).join(labels.select("doc_id", "quality"), "doc_id").orderBy("doc_id").toPandas()
    y, held = rows.quality.to_numpy(), rows.held_out.to_numpy()
    plain, ours, right = plain_scores(rows.text.tolist(), y, ~held)[held], rows.score.to_numpy()[held], y[held]
    auc = lambda s: (np.sign(s[right == 1][:, None] - s[right == 0][None, :]) + 1).mean() / 2
    assert auc(ours) >= auc(plain) - 0.01 and ((ours >= 0.3) == right).mean() >= 0.95


def test_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.judged(docs, none).collect()} == {0.5}
    assert quality.judged(no_docs, none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.judged(docs, one).collect())


def test_dual_descent_meets_the_margin():
    rows = [np.array([0, 2]), np.array([0]), np.array([1]), np.array([1, 2])]
    values = [np.ones(len(r)) for r in rows]
    y = np.array([1, 1, 0, 0])
    w, b = quality.dual_descent(rows, values, y, 10.0, 200, 0)
    assert all((2 * t - 1) * (w[r] @ v + b) > 0.98 for r, v, t in zip(rows, values, y))
