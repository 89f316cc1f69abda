import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import attach, errors, metrics, report, stats
from riskframe.operators.prefix import exact_quantiles, running

ROWS = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.4), (1, 0.4), (0, 0.1), (0, 0.05), (1, 0.05)]


def frame(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "sample_id string, label int, prob double")
    return df.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def test_ranking_with_ties(spark):
    row = metrics.ranking_metrics(frame(spark, ROWS)).first()
    assert row.auroc == pytest.approx(0.59375) and row.pr_auc == pytest.approx(0.566667, abs=1e-6)


def test_one_class(spark):
    df = frame(spark, [(0, 0.1), (0, 0.2)])
    row = metrics.full_report(df).first()
    assert (row.precision, row.recall, row.f1, row.mcc, row.auroc) == (0, 0, 0, 0, None)


def test_bins(spark):
    p = [0.1, 0.2, 0.3, 0.6, 0.7, 0.8, 0.9, 1.0, 0.0]
    df = spark.createDataFrame([(x,) for x in p], "p double").select(metrics.bin_of(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [1, 2, 2, 5, 6, 8, 9, 9, 0]


def test_ece_and_curve(spark):
    df = frame(spark, ROWS)
    assert metrics.ece(df).first().ece == pytest.approx(sum(n / 8 * abs(a - c) for n, a, c in ((2, 0.5, 0.9), (1, 1, 0.8), (2, 0.5, 0.4), (1, 0, 0.1), (2, 0.5, 0.05))))
    points = metrics.curve(df).orderBy(F.desc("score")).collect()
    assert len(points) == 5 and points[-1].tpr == points[-1].fpr == 1.0 and points[0].precision == 0.5


def test_threshold(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)], "label int, overlap double")
    best = metrics.best_threshold(df).first()
    assert (best.threshold, best.f1) == (pytest.approx(0.21), 1.0)
    assert metrics.best_threshold(df.filter("label = 0"), none_at=0.5).first().threshold == 0.5


def test_every_threshold_counts_at_its_exact_value(spark):
    """Overlaps at, just below and just above each threshold."""
    values = sorted({v for t in metrics.THRESHOLDS for v in (t, math.nextafter(t, 0), min(1.0, math.nextafter(t, 2)), min(1.0, t + 0.004))})
    rows = [(i % 2, v) for i, v in enumerate(values)]
    got = {r.threshold: r.f1 for r in metrics.threshold_sweep(spark.createDataFrame(rows, "label int, overlap double")).collect()}
    for t in metrics.THRESHOLDS:
        tp, pp = sum(v < t and y for y, v in rows), sum(v < t for _, v in rows)
        assert got[t] == pytest.approx(2 * tp / (pp + sum(y for y, _ in rows)))


def test_running_and_quantiles(spark):
    rng = random.Random(5)
    values = [round(rng.random(), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    for r in running(df, "v", ["n"], buckets=8).collect():
        assert r.before_n == sum(v < r.v for v in values) and r.all_n == 500
    got = {r.share: r.quantile for r in exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.5, 0.95, 0.0, 1.0]).collect()}
    ordered = sorted(values)
    for share, q in got.items():
        at = share * 499
        assert q == pytest.approx(ordered[math.floor(at)] + (ordered[math.ceil(at)] - ordered[math.floor(at)]) * (at - math.floor(at)))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, pred_a int, pred_b int")


def test_mcnemar(spark):
    same = stats.mcnemar(pairs(spark, [(1, 1, 1), (0, 1, 1)])).first()
    assert (same.b, same.c, same.p) == (0, 0, 1.0)
    one = stats.mcnemar(pairs(spark, [(1, 1, 0), (1, 1, 0), (1, 0, 1)])).first()
    assert (one.b, one.c, one.statistic, one.p) == (2, 1, 0.0, 1.0)
    by_prediction = stats.mcnemar_counts(pairs(spark, [(0, 1, 0)]), "prediction").first()
    assert (by_prediction.b, by_prediction.c) == (1, 0)


def test_wilcoxon(spark):
    kind = "a double, b double"
    assert stats.wilcoxon(spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 1.0)], kind)).first().p == pytest.approx(0.25)
    assert stats.wilcoxon(spark.createDataFrame([(1.0, 1.0)], kind)).first().p is None


def test_bootstrap_holds_the_estimate(spark):
    rng = random.Random(1)
    rows = [(y, min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2)))) for y in [0, 1] * 150]
    df = frame(spark, rows)
    point = metrics.full_report(df).first()
    for r in stats.bootstrap(df, 60).collect():
        assert r.low < point[r.metric] < r.high and r.high - r.low < 0.2


def test_taxonomy(spark):
    base = dict(n_words=20, overlap_answer_context=0.5, nli_ctx_contradicts_ans=0.0, nli_ctx_entails_ans=0.0, n_entities_answer=1, context="c" * 100, answer="a" * 60)
    wanted = [
        ({"n_words": 4}, "short_answer_ambiguity"),
        ({"nli_ctx_entails_ans": 0.9, "overlap_answer_context": 0.7}, "label_ambiguity"),
        ({"nli_ctx_contradicts_ans": 0.6, "overlap_answer_context": 0.1}, "label_ambiguity"),
        ({"n_entities_answer": 0}, "entity_extraction_failure"),
        ({"context": "short"}, "weak_context"),
        ({"answer": "a" * 30, "n_words": 8}, "short_answer_ambiguity"),
        ({"overlap_answer_context": 0.7}, "unsupported_but_semantically_similar"),
        ({}, "other"),
        ({"n_words": 3, "n_entities_answer": 0}, "short_answer_ambiguity"),
        ({"n_entities_answer": None, "context": "short"}, "entity_extraction_failure"),
    ]
    kind = "n_words int, overlap_answer_context double, nli_ctx_contradicts_ans double, nli_ctx_entails_ans double, n_entities_answer int, context string, answer string"
    df = spark.createDataFrame([tuple({**base, **change}.values()) for change, _ in wanted], kind)
    assert [r.c for r in df.select(errors.category().alias("c")).collect()] == [w for _, w in wanted]


def test_attach_checks(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "sample_id string"), spark.createDataFrame([("1",), ("1",)], "sample_id string")
    with pytest.raises(attach.AlignmentError):
        attach.check_one_to_one(a, b)
    attach.check_one_to_one(a, a)


def test_nli_of_blank_contexts(spark):
    samples = spark.createDataFrame([(1, " "), (2, "c"), (3, "c")], "item_idx long, context string")
    scores = spark.createDataFrame([(2, 0.1, 0.2, 0.7, 0.3, 0.3, 0.4)], "item_idx long, ctx_contradiction double, ctx_entailment double, ctx_neutral double, ans_contradiction double, ans_entailment double, ans_neutral double")
    rows = {r.item_idx: r for r in attach.attach_nli(samples, scores).collect()}
    assert rows[1].nli_ctx_entails_ans == rows[1].nli_ans_neutral_ctx == 0.333333 and rows[2].nli_ctx_entails_ans == 0.2
    with pytest.raises(attach.AlignmentError):
        attach.check_nli(attach.attach_nli(samples, scores))


def test_entities_given(spark):
    samples = spark.createDataFrame([("1",), ("2",)], "sample_id string")
    given = spark.createDataFrame([("1", "answer", "Paris"), ("1", "answer", "PARIS"), ("1", "context", "Rome")], "sample_id string, side string, entity string")
    rows = {r.sample_id: r for r in attach.attach_entities(samples, given).collect()}
    assert rows["1"].ent_answer == ["paris"] and rows["2"].ent_context == []


def test_manifest_ignores_order(spark):
    a = spark.range(10).repartition(3)
    b = spark.range(10).orderBy(F.desc("id"))
    rows = report.manifest({"a": a, "b": b, "c": spark.range(11)}).collect()
    assert rows[0].content == rows[1].content != rows[2].content
