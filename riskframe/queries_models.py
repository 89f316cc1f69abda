"""Queries that fit models, whose rows depend on MLlib, so that SQL gives few of them; and others beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions import measures as m
from riskframe.operators import errors, metrics, report, splits, stats
from riskframe.plans import calibrate, explain, features as ft, models, score, semantic
from riskframe.queries import clean, query, rounded
from riskframe.sources import records, views
from riskframe.streaming import score_stream as streaming


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The split samples with their texts, stored."""
    return records.stored(splits.with_split(clean(spark, d)), "samples")


def prepared(spark: SparkSession, d: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The split table of all feature groups, stored: every fit and prediction reads it; and the weights of its cosines.

    Samples without inference scores have them at their defaults. Texts stay in the samples.
    """
    rows = samples(spark, d) if rows is None else rows
    idf = semantic.fit_tfidf(rows.filter("split = 'train'"))
    full = ft.slim_features(rows, views.nli_scores(spark, d), semantic.tfidf_cosines(idf, rows))
    return records.stored(errors.with_defaults(full), "features"), idf


def data(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d)[0]


def columns(df: DataFrame) -> list[str]:
    return ft.columns_of(df)


def boosted_scores(spark: SparkSession, d: str) -> tuple[DataFrame, models.PipelineModel]:
    df = data(spark, d)
    model = models.fit_boosted(df, columns(df), 42)
    return models.predict(model, df), model


def scorer(df: DataFrame, idf: DataFrame, **params) -> score.Scorer:
    """Boosted trees of the train rows with their calibrator, saved as one bundle and loaded from it."""
    raw = models.fit_boosted(df, columns(df), 42, **params)
    platt = calibrate.fit_platt(models.predict(raw, df.filter("split = 'val'")))
    path = records.scratch_path(df.sparkSession, "scorer")
    score.Scorer(raw, platt, columns(df), idf=idf).save(path)
    return score.load_scorer(path)


@query
def a3_source_choice(spark, d):
    """Groups there are in full, for the full table and for one without the entity group."""
    df = ft.text_features(clean(spark, d))
    core = df.drop("n_entities_answer")
    rows = [(name, c) for name, t in (("full", df), ("core", core)) for c in ft.columns_of(t)]
    return spark.createDataFrame(rows, "source string, feature string").join(df.agg(F.count("*").alias("rows")))


@query
def a4_cached_table(spark, d):
    path = records.scratch_path(spark, "cached")
    records.cached_table(report.label_balance(clean(spark, d)), path)
    return records.cached_table(report.label_balance(clean(spark, d)).limit(0), path)


@query
def a6_model_bundle(spark, d):
    """Calibrated predictions of a saved and loaded logistic pipeline on test rows, whose cosines come from the bundle's own weights."""
    rows = samples(spark, d)
    df, idf = prepared(spark, d, rows)
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    path = records.scratch_path(spark, "bundle")
    raw = models.fit_logistic(train, columns(df))
    score.Scorer(raw, calibrate.fit_platt(models.predict(raw, val)), columns(df), "logistic", idf).save(path)
    own = score.load_scorer(path)
    test = df.filter("split = 'test'").drop("cosine_ctx_ans", "cosine_q_ans")
    test = test.join(semantic.tfidf_cosines(own.idf, rows.filter("split = 'test'")), "sample_id").select("sample_id", "label", *own.columns)
    return calibrate.calibrated(own.pipeline, test).select("sample_id", "label", F.round("prob", 6).alias("prob"), "pred")


@query
def b4_line_numbers(spark, d):
    path = records.scratch_path(spark, "lines")
    views.table(spark, d, "benchmark").orderBy("item_id").select(F.to_json(F.struct("item_id", "text")).alias("value")).write.text(path)
    line = F.from_json("value", "item_id long, text string")
    return records.number_lines(spark.read.text(path)).select("item_idx", line.alias("v")).select("item_idx", "v.item_id", F.length("v.text").cast("long").alias("n_chars"))


@query
def b7_feature_columns(spark, d):
    df = ft.text_features(clean(spark, d)).drop("hedge_count")
    return df.select("sample_id", *ft.columns_of(df))


@query
def f3_random_search(spark, d):
    """Points of the grid, with the number of rows each would be fitted on."""
    rows = [(i, p["maxDepth"], p["stepSize"], p["maxIter"], p["subsamplingRate"], p["featureSubsetStrategy"]) for i, p in enumerate(models.random_params())]
    points = spark.createDataFrame(rows, "point int, max_depth int, step_size double, max_iter int, subsampling double, features string")
    return points.join(clean(spark, d).agg(F.count("*").alias("rows")))


@query
def h1_best_threshold(spark, d):
    """The overlap threshold of best F1 on validation rows, and what it gives on test rows."""
    df = records.stored(ft.text_features(splits.with_split(clean(spark, d)), ("lexical",)), "features")
    best = metrics.best_threshold(df.filter("split = 'val'"), "overlap_answer_context").first()
    test = df.filter("split = 'test'").withColumn("pred", (F.col("overlap_answer_context") < best.threshold).cast("int"))
    return metrics.point_metrics(test).withColumn("threshold", F.lit(best.threshold))


@query
def h2_scaled(spark, d):
    """Mean and deviation that the scaler takes from train rows, for the features that come without a fit of their own."""
    df = errors.with_defaults(ft.full_features(splits.with_split(clean(spark, d)), views.nli_scores(spark, d)))
    wanted = [f for g in ft.GROUPS if g != "semantic" for f in ft.GROUPS[g]]
    scaler = models.Pipeline(stages=models.logistic(wanted, 1).getStages()[:2]).fit(df.filter("split = 'train'")).stages[-1]
    rows = [(f, float(a), float(b)) for f, a, b in zip(wanted, scaler.mean, scaler.std)]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, std double"), 6, "mean", "std")


@query
def h3_logistic(spark, d):
    df = data(spark, d)
    train = df.filter("split = 'train'")
    scored = models.predict(models.fit_logistic(train, columns(df)), df.filter("split = 'test'"))
    return rounded(metrics.full_report(scored), 6, "f1", "auroc", "pr_auc", "ece", "brier")


@query
def h4_forest(spark, d):
    df = data(spark, d)
    scored = models.predict(models.fit_forest(df, columns(df), 42), df.filter("split = 'test'"))
    return metrics.full_report(scored)


@query
def h5_boosted(spark, d):
    scored, _ = boosted_scores(spark, d)
    return metrics.full_report(scored.filter("split = 'test'"))


@query
def h7_tuning(spark, d):
    """The best of the 30 sampled points by five group folds."""
    df = data(spark, d)
    best, auc = models.tune(df.filter("split = 'train'"), columns(df), models.random_params())
    row = (best["maxDepth"], best["stepSize"], best["maxIter"], best["subsamplingRate"], best["featureSubsetStrategy"], auc)
    kinds = "max_depth int, step_size double, max_iter int, subsampling double, features string, cv_auroc double"
    return spark.createDataFrame([row], kinds).join(df.agg(F.count("*").alias("rows")))


@query
def h8_seed_protocol(spark, d):
    df = data(spark, d)
    trees = models.protocol(df, columns(df), models.SEEDS, "random_forest", models.fit_forest)
    return report.over_seeds(models.union(models.concurrently(trees + models.protocol(df, columns(df), models.SEEDS, "boosted_trees", models.fit_boosted))))


@query
def h9_ablation(spark, d):
    return models.ablation(data(spark, d))


@query
def h10_predictions(spark, d):
    scored, _ = boosted_scores(spark, d)
    return scored.select("sample_id", "split", "label", "prob", "pred")


@query
def i10_external(spark, d):
    """A frozen model on responses that it was not fitted on."""
    own = scorer(*prepared(spark, d))
    outside = score.features_of(records.normalise_responses(views.responses(spark, d)), own)
    return metrics.full_report(calibrate.calibrated(own.pipeline, outside))


@query
def j1_platt(spark, d):
    scored, _ = boosted_scores(spark, d)
    return calibrate.apply_platt(calibrate.fit_platt(scored.filter("split = 'val'")), scored).select("sample_id", "split", "prob")


@query
def j2_isotonic(spark, d):
    scored, _ = boosted_scores(spark, d)
    return calibrate.apply_isotonic(calibrate.fit_isotonic(scored.filter("split = 'val'")), scored).select("sample_id", "split", "prob")


def means(df: DataFrame, value: str) -> DataFrame:
    """(method, metric) rows with the mean of the value over the seeds, and the values in seed order."""
    return report.over_seeds(df.select(F.col("method").alias("model"), "metric", "seed", F.col(value).alias("value"))).select(F.col("model").alias("method"), "metric", F.col("mean").alias(value), "values")


@query
def j3_calibration(spark, d):
    """F1, ECE and Brier of raw and calibrated probabilities: means over three seeds, and the seeds' values."""
    df = data(spark, d)
    return means(calibrate.over_seeds(df, columns(df)), "value")


@query
def j4_calibrated_scores(spark, d):
    df, idf = prepared(spark, d)
    return calibrate.calibrated(scorer(df, idf).pipeline, df).select("sample_id", "split", "raw_prob", "prob", "pred")


@query
def k5_calibration_gain(spark, d):
    """What calibration adds to each figure: means over three seeds, and the seeds' differences."""
    df = data(spark, d)
    return means(stats.calibration_gain(calibrate.over_seeds(df, columns(df))), "gain")


@query
def k4_wilcoxon_models(spark, d):
    """Boosted trees against the forest by their F1 over the seeds. Forests, which take longest, are submitted first."""
    df = data(spark, d)
    tasks = models.protocol(df, columns(df), models.SEEDS, "b", models.fit_forest) + models.protocol(df, columns(df), models.SEEDS, "a", models.fit_boosted)
    f1 = models.union(models.concurrently(tasks)).filter("metric = 'f1'")
    return stats.wilcoxon(f1.groupBy("seed").pivot("model", ["a", "b"]).agg(F.first("value")))


def attributions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scored rows, and their attributions in long form."""
    scored, model = boosted_scores(spark, d)
    scored = records.stored(scored, "scored")
    impacts = explain.tree_attributions(scored, model, columns(scored))
    return scored, records.stored(explain.long_attributions(scored.join(impacts, "sample_id"), columns(scored)), "attributions")


@query
def l1_tree_attributions(spark, d):
    return attributions(spark, d)[1]


@query
def l2_global_importance(spark, d):
    return explain.global_importance(attributions(spark, d)[1])


@query
def l3_local_top(spark, d):
    return explain.local_top(attributions(spark, d)[1])


@query
def l5_summary(spark, d):
    scored, impacts = attributions(spark, d)
    return explain.summary(explain.global_importance(impacts), metrics.ece(scored), metrics.brier(scored), explain.three_cases(scored))


@query
def n2_scores(spark, d):
    own = scorer(*prepared(spark, d))
    return score.scored(views.qa_turns(spark, d), own).select("sample_id", "risk_score", "label", "version", "warning")


@query
def n3_explanations(spark, d):
    return score.explained(views.qa_turns(spark, d), scorer(*prepared(spark, d)))


@query
def n5_scores_with_explanations(spark, d):
    return score.scored_and_explained(views.qa_turns(spark, d), scorer(*prepared(spark, d))).select("sample_id", "risk_score", "label", "explanation")


@query
def n6_readiness(spark, d):
    df = ft.text_features(clean(spark, d))
    return ft.readiness(df, ft.ALL_FEATURES).join(df.agg(F.count("*").alias("rows")))


#: Requests that can't be scored, which come with the turns: (case, question, context, answer).
BAD_REQUESTS = [("null", "q", "c", None), ("blank", "q", "c", " \t"), ("long", "q" * 5_001, "c", "a"), ("context", "q", "c" * 20_001, "a"), ("answer", "q", "c", "a" * 20_001)]


def streamed(spark: SparkSession, d: str, risk, version: str = "") -> str:
    """The folder that a stream over request files wrote: the turns, and each conversation's first turn once for each bad request.

    Requests come in two batches of packed files. A packed file is one task, so there are as many files as cores, 4 at least.
    """
    path = records.scratch_path(spark, "stream")
    turns = views.qa_turns(spark, d).select("sample_id", "question", "context", "answer")
    first = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    cases = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("case", "question", "context", "answer"), r)]) for r in BAD_REQUESTS])
    bad = first.select("conv_id", F.inline(cases)).select(F.concat_ws("_", "case", "conv_id").alias("sample_id"), "question", "context", "answer")
    a_batch = max(2, spark.sparkContext.defaultParallelism // 2)
    turns.unionByName(bad).repartition(2 * a_batch).write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{path}/in")
    streaming.score_stream(streaming.read_requests(spark, f"{path}/in", a_batch), risk, f"{path}/out", f"{path}/checkpoint", once=True, version=version).awaitTermination()
    return f"{path}/out"


def overlap_risk(batch: DataFrame) -> DataFrame:
    p = m.clamp(1 - F.col("overlap_answer_context"))
    return ft.text_features(batch, ("lexical",)).select("sample_id", F.round(p, 4).alias("risk_score"), m.risk_label(p).alias("label"))


SCORED = "sample_id string, risk_score double, label string"


@query
def n7_stream(spark, d):
    """Requests that arrive as files, scored by overlap: what the batches wrote."""
    return streaming.written(spark, streamed(spark, d, overlap_risk), "scores", SCORED)


@query
def n7_stream_rejected(spark, d):
    """Requests that arrive as files and can't be scored, with their reasons."""
    return streaming.written(spark, streamed(spark, d, overlap_risk), "rejected", "sample_id string, reason string")


@query
def n7_stream_scored(spark, d):
    """Requests that arrive as files, scored by a loaded scorer: what the batches wrote."""
    own = scorer(*prepared(spark, d))
    out = streamed(spark, d, lambda batch: score.scored(batch, own).select("sample_id", "risk_score", "label"), own.version)
    return streaming.written(spark, out, "scores", SCORED)


@query
def z1_shortcut_controls(spark, d):
    """Test metrics of the majority class, and of logistic models on one feature group each: answers, contexts, figures, inference
    scores or TF-IDF cosines alone."""
    df = data(spark, d)
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    majority = train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
    controls = {"majority": test.withColumns({"prob": F.lit(0.5), "pred": F.lit(majority.label if majority else 0)})}
    for group in ("length", "lexical", "entity", "numeric", "nli", "semantic"):
        controls[group] = models.predict(models.fit_logistic(train, ft.GROUPS[group]), test)
    out = None
    for name, scored in controls.items():
        scored = records.stored(scored.select("label", "prob", "pred"), "scored")
        row = metrics.point_metrics(scored).crossJoin(F.broadcast(metrics.ranking_metrics(scored))).select(F.lit(name).alias("control"), "f1", "auroc")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query
def z5_rank_agreement(spark, d):
    """How far two views of importance agree: over feature groups, the correlation of ranks by attribution and by the F1 lost without
    the group; over test rows, the Jaccard index of the five strongest features before and after the answer loses its last sentence."""
    texts = samples(spark, d)
    df, idf = prepared(spark, d, texts)
    own = scorer(df, idf)
    test = df.filter("split = 'test'")

    def impacts(rows: DataFrame) -> DataFrame:
        return records.stored(explain.long_attributions(rows.join(explain.tree_attributions(rows, own.raw, columns(df)), "sample_id"), columns(df)), "impacts")

    before = impacts(test)
    shorter = texts.filter("split = 'test'").select("sample_id", "question", "context", perturbed("drop_sentence").alias("answer"))
    after = impacts(records.stored(score.features_of(shorter, own).select("sample_id", *columns(df)), "shorter"))  # read for the trees and beside what they give
    top = lambda df, name: explain.local_top(df).groupBy("sample_id").agg(F.collect_set("feature").alias(name))
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    overlap = top(before, "x").join(top(after, "y"), "sample_id").agg(F.avg(jaccard).alias("top5_jaccard"), F.count("*").alias("rows"))
    group_of = F.create_map(*[F.lit(x) for g, fs in ft.GROUPS.items() for f in fs for x in (f, g)])
    by_group = before.groupBy(group_of[F.col("feature")].alias("model")).agg(F.sum(F.abs("impact")).alias("impact"))
    without = models.ablation(df, seeds=(42,)).filter("metric = 'f1'").select(F.col("removed_group").alias("model"), F.col("mean").alias("f1"))
    pairs = [(r.impact, -r.f1) for r in by_group.join(without, "model").collect()]  # a row for each group
    rank = lambda xs: [1 + sum(y < x for y in xs) + (sum(y == x for y in xs) - 1) / 2 for x in xs]
    ranks = spark.createDataFrame(list(zip(*[rank(x) for x in zip(*pairs)])), "a double, b double")
    return ranks.agg(F.corr("a", "b").alias("spearman"), F.count("*").alias("groups")).crossJoin(F.broadcast(overlap))  # one row each


def perturbed(how: str) -> Column:
    """The answer, changed: without its last sentence, with a sentence more, with other figures, with other names.

    A last sentence is looked for only where one can begin, and nothing that it takes is given back, so that long ones cost no square.
    """
    answer = F.col("answer")
    return {
        "none": answer, "drop_sentence": F.regexp_replace(answer, r"(?<![^.!?])[^.!?]*+[.!?]*+\s*$", ""), "insert_sentence": F.concat(answer, F.lit(" This holds in every case.")),
        "change_numbers": F.regexp_replace(answer, "[0-9]", "7"), "change_entities": F.regexp_replace(answer, r"\p{Lu}[\p{L}\p{N}_]*", "Other"),
    }[how]


@query
def z6_perturbations(spark, d):
    """Overlap, novel figures and entities before and after controlled changes of the answers."""
    df = clean(spark, d)
    out = None
    for name in ("none", "drop_sentence", "insert_sentence", "change_numbers", "change_entities"):
        made = ft.text_features(df.withColumn("answer", perturbed(name)), ("lexical", "numeric", "entity"))
        row = made.agg(*[F.round(F.avg(f), 6).alias(c) for f, c in (("overlap_answer_context", "overlap"), ("novel_numbers", "novel_numbers"), ("novel_entity_ratio", "novel_entities"))], F.count("*").alias("rows"))
        row = row.withColumn("perturbation", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
