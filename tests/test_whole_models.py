import inspect

from oracle import DATA, needs_data
from pyspark.sql import functions as F

from riskframe import queries_models as qm
from riskframe.plans import features as ft, models, score
from riskframe.plans.models import tune
from riskframe.sources import views


@needs_data
def test_single_models_use_all_features_and_the_defaults(spark):
    df, idf = qm.prepared(spark, str(DATA))
    every = [f for g in ft.GROUPS for f in ft.GROUPS[g]]
    assert qm.columns(df) == every and df.na.drop(subset=every).count() == df.count()
    spread = df.agg(*[F.count_distinct(c).alias(c) for c in ("nli_ctx_entails_ans", "cosine_ctx_ans")]).first()
    assert min(spread) > 10
    own = qm.scorer(df, idf)
    trees = own.raw.stages[-1]
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.numFeatures) == (300, 5, 0.05, 26)
    turns = views.qa_turns(spark, str(DATA))
    made = score.features_of(turns, own)
    assert made.na.drop(subset=every).count() == turns.count() and made.filter("cosine_q_ans > 0").count() > 0


@needs_data
def test_protocol_queries_do_the_whole_job(spark, monkeypatch):
    """Fits are counted, not run."""
    rows = spark.createDataFrame([(1, 1, 0.9, 1), (2, 0, 0.1, 0)], "sample_id int, label int, prob double, pred int")
    fitted, tuned = [], []
    monkeypatch.setattr(models, "predict", lambda model, df: rows)
    fit = lambda kind: lambda df, columns, seed, **params: fitted.append((kind, seed, len(columns), params))
    boosted = fit("boosted")
    monkeypatch.setattr(models, "fit_boosted", boosted)
    monkeypatch.setattr(models, "fit_forest", fit("forest"))
    monkeypatch.setattr(models.over_protocol, "__defaults__", (models.SEEDS, "boosted_trees", boosted))
    monkeypatch.setattr(models, "tune", lambda df, columns, points, **params: tuned.append((len(columns), points, params)) or (points[0], 0.5))
    assert {r.removed_group for r in qm.h9_ablation(spark, str(DATA)).collect()} == set(ft.GROUPS)
    assert sorted({x[1] for x in fitted}) == sorted(models.SEEDS) and len(fitted) == 21 and not any(x[3] for x in fitted)
    fitted.clear()
    assert {r.model for r in qm.h8_seed_protocol(spark, str(DATA)).collect()} == {"boosted_trees", "random_forest"}
    assert sorted(fitted) == [(kind, seed, 26, {}) for kind in ("boosted", "forest") for seed in sorted(models.SEEDS)]
    assert qm.h7_tuning(spark, str(DATA)).count() == 1
    assert tuned == [(26, models.random_params(), {})] and len(models.random_params()) == 30
    assert inspect.signature(tune).parameters["n_folds"].default == 5
