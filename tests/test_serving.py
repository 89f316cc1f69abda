import pytest
from oracle import DATA, needs_data
from pyspark.sql import functions as F

from riskframe import queries_models as qm
from riskframe.functions.measures import risk_label
from riskframe.plans import calibrate, explain, models, score
from riskframe.sources import views


@pytest.fixture(scope="module")
def own(spark):
    """A scorer of few rounds on the given tables."""
    df, idf = qm.prepared(spark, str(DATA))
    model = models.fit_boosted(df, qm.columns(df), 42, maxIter=4, maxDepth=3)
    return score.Scorer(model, calibrate.fit_platt(models.predict(model, df.filter("split = 'val'"))), qm.columns(df), version="7", idf=idf)


@pytest.fixture(scope="module")
def requests(spark):
    turns = views.qa_turns(spark, str(DATA)).select("sample_id", "question", "context", "answer")
    bad = [("none", "q", "c", None), ("blank", "q", "c", " \t"), ("long", "q", "c", "x" * 20_001), ("context", "q", "c" * 20_001, "a"), ("question", "q" * 5_001, "c", "a")]
    return turns.union(spark.createDataFrame([*bad, ("fits", "q" * 5_000, "", "x " * 10_000), ("nulls", None, None, "An answer.")], "sample_id string, question string, context string, answer string"))


@needs_data
def test_scores(requests, own):
    rows = score.scored(requests, own)
    got = {r.sample_id: r for r in rows.collect()}
    assert set(got) == {r.sample_id for r in requests.collect()} - {"none", "blank", "long", "context", "question"}
    assert {r.sample_id for r in score.rejected(requests).collect()} == {"none", "blank", "long", "context", "question"}
    assert all(0.001 <= r.risk_score <= 0.999 and r.version == "7" and r.warning for r in got.values())
    assert rows.filter(F.col("label") != risk_label(F.col("risk_score"))).filter("abs(risk_score - 0.3) > 1e-4 and abs(risk_score - 0.7) > 1e-4").count() == 0
    assert got["nulls"].nli_ctx_entails_ans == pytest.approx(1 / 3) and got["nulls"].cosine_ctx_ans == 0


@needs_data
def test_explanations_add_up_and_are_the_strongest(requests, own):
    features = score.features_of(score.accepted(requests), own)
    whole = explain.long_attributions(features.join(explain.tree_attributions(features, own.raw, own.columns), "sample_id"), own.columns)
    size = {}
    for r in whole.collect():
        size.setdefault(r.sample_id, []).append((-abs(round(r.impact, 6)), r.feature))
    top = {}
    for r in score.explained(requests, own).collect():
        top.setdefault(r.sample_id, {})[r["rank"]] = (-abs(r.impact), r.feature)
    assert set(top) == set(size)
    for sample, ranks in top.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5] and [x[0] for _, x in sorted(ranks.items())] == pytest.approx([x[0] for x in sorted(size[sample])[:5]], abs=2e-6)


@needs_data
def test_scores_with_explanations_agree_with_both(requests, own):
    scores = {r.sample_id: (r.risk_score, r.label) for r in score.scored(requests, own).collect()}
    first = {r.sample_id: r.feature for r in score.explained(requests, own).filter("rank = 1").collect()}
    both = score.scored_and_explained(requests, own).collect()
    assert {r.sample_id: (r.risk_score, r.label) for r in both} == scores
    assert all(len(r.explanation) == 5 and r.explanation[0]["feature"] == first[r.sample_id] for r in both)


def test_tuning_judges_on_rows_it_was_not_fitted_on(spark, monkeypatch):
    """Folds and stopping rows hold whole groups, and the best mean over folds wins."""
    rows = spark.range(240).select(F.col("id").alias("sample_id"), (F.col("id") % 60).alias("item_idx"), (F.col("id") % 2).cast("int").alias("label"))
    df = rows.withColumn("x", F.col("label") + F.pmod(F.xxhash64("sample_id"), F.lit(100)) / 60).withColumn("noise", F.rand(1))
    seen = []
    kept = models.stored
    monkeypatch.setattr(models, "stored", lambda t, name: seen.append(kept(t, name)) or seen[-1])
    best, auc = models.tune(df, ["x", "noise"], [{"maxDepth": 1, "maxIter": 1, "stepSize": 0.1}, {"maxDepth": 3, "maxIter": 5, "stepSize": 0.3}], n_folds=3)
    assert 0.5 < auc <= 1 and best in ({"maxDepth": 1, "maxIter": 1, "stepSize": 0.1}, {"maxDepth": 3, "maxIter": 5, "stepSize": 0.3})
    assert seen[0].groupBy("item_idx").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
