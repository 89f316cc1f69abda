"""The engine's operators applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions import measures as m, text as t
from riskframe.functions.judge import parse_reply
from riskframe.operators import attach, errors, gazetteer, metrics, perturb, report, splits, stats
from riskframe.oracles import SQL, TABLES  # noqa: F401
from riskframe.plans import features as ft
from riskframe.sources import records, unified, views

#: Weights of the linear margin that is explained.
LINEAR = {"n_words": 0.1, "n_sentences": -0.3, "overlap_answer_context": -2.0, "jaccard_ans_q": 1.5}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def clean(spark: SparkSession, d: str) -> DataFrame:
    return views.qa_clean(spark, d)


def featured(spark: SparkSession, d: str, *groups: str) -> DataFrame:
    return ft.text_features(clean(spark, d), groups or (*ft.CORE, "entity"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    df = views.predictions(spark, d)
    return df.withColumns({"pred": (F.col("prob") >= 0.5).cast("int"), "pred_b": (F.col("prob_b") >= 0.5).cast("int")})


def risky(spark: SparkSession, d: str) -> DataFrame:
    """Features with inference scores and the overlap heuristic as prediction."""
    return predicted_by_overlap(attach.attach_nli(featured(spark, d), views.nli_scores(spark, d)))


def predicted_by_overlap(df: DataFrame) -> DataFrame:
    return df.withColumn("prob", 1 - F.col("overlap_answer_context")).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query
def entry(spark, d):
    """Which answers lack support in their context: rows by label and risk."""
    df = featured(spark, d, "lexical").withColumn("p", 1 - F.col("overlap_answer_context"))
    return df.groupBy("label", m.risk_label(m.clamp(F.col("p"))).alias("risk")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_risk"))


@query
def a1_jsonl_scan(spark, d):
    path = records.scratch_path(spark, "qa_jsonl")
    views.qa_raw(spark, d).drop("id").write.option("ignoreNullFields", "false").json(path)
    parsed = records.stored(records.read_jsonl(spark, path), "parsed")  # Spark can't query the column of bad lines alone before that
    return parsed.filter("_corrupt is null").agg(
        F.count("*").alias("records"), F.sum(F.length("question")).alias("question_chars"), F.sum(F.length("right_answer")).alias("answer_chars"), F.sum(F.col("hallucinated_answer").isNull().cast("long")).alias("without")
    )


@query
def a2_parquet_scan(spark, d):
    rows = views.table(spark, d, "lineitem").filter("l_shipdate >= timestamp '1995-01-01'")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query
def a5_sinks(spark, d):
    """What each sink gives back."""
    path = records.scratch_path(spark, "clean")
    records.write_tables(records.stored(splits.with_split(clean(spark, d)), "split"), path)
    keys = "sample_id string, item_idx long, label int, split string"
    sinks = {
        "parquet": spark.read.schema(keys).parquet(f"{path}/parquet"), "json": spark.read.schema(keys).json(f"{path}/json"),
        "csv": spark.read.schema(keys).option("header", True).csv(f"{path}/csv"),
    }
    out = None
    for name, df in sinks.items():
        rows = df.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum("item_idx").alias("ids"), F.count_distinct("sample_id").alias("samples")).withColumn("sink", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def a7_provenance(spark, d):
    """What the inference scores are: their table, class order, directions, samples with and without them."""
    return attach.provenance(clean(spark, d), views.nli_scores(spark, d), "embeddings")


@query
def b1_fields(spark, d):
    return records.qa_fields(views.qa_raw(spark, d))


@query
def b2_dropped(spark, d):
    """Raw records, and those left without the ones that lack a question or a right answer."""
    raw = views.qa_raw(spark, d)
    kept = records.qa_fields(raw).agg(F.count("*").alias("kept"))
    return raw.agg(F.count("*").alias("records")).crossJoin(F.broadcast(kept))  # one row each


@query
def b3_expand(spark, d):
    return clean(spark, d)


@query
def b5_labelled(spark, d):
    labels = views.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return records.labelled(views.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left"))


@query
def b6_responses(spark, d):
    return records.normalise_responses(views.responses(spark, d))


@query
def b8_split_filter(spark, d):
    return records.in_split(splits.with_split(clean(spark, d)), "val").select("sample_id", "item_idx", "label")


@query
def b9_projections(spark, d):
    p = m.clamp(F.col("prob"))
    return views.predictions(spark, d).select("sample_id", F.round(p, 4).alias("risk_score"), F.round(p, 6).alias("clamped"), records.prefix(F.col("sample_id"), 4).alias("short"))


@query
def b10_risk_label(spark, d):
    return views.predictions(spark, d).select("sample_id", m.risk_label(m.clamp(F.col("prob"))).alias("label"))


@query
def b11_display_band(spark, d):
    return views.predictions(spark, d).select("sample_id", m.display_band(F.col("prob")).alias("band"))


@query
def c_length_features(spark, d):
    return featured(spark, d, "length").select("sample_id", *ft.GROUPS["length"])


@query
def c5_tokens(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", m.size(t.found(F.lower("text"), t.TOKEN)).alias("n_tokens"), m.size(t.tokens(F.col("text"))).alias("n_distinct"))


@query
def c6_numbers(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_sort(t.numbers(F.col("text"))).alias("numbers"))


@query
def c7_hedging(spark, d):
    return featured(spark, d, "hedging").select("sample_id", *ft.GROUPS["hedging"])


@query
def c9_blank_context(spark, d):
    return clean(spark, d).select("sample_id", t.is_blank(F.col("context")).alias("blank_context"))


@query
def c10_entities(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_sort(t.entities(F.col("text"))).alias("entities"))


@query
def c11_judge_parse(spark, d):
    return views.judge_replies(spark, d).select("doc_id", parse_reply(F.col("reply")).alias("v")).select("doc_id", "v.judgment", "v.confidence", "v.parsed")


@query
def c12_plain_names(spark, d):
    types = views.table(spark, d, "events").select(F.col("event_type").alias("feature"))
    known = spark.createDataFrame([(k,) for k in m.PLAIN_NAMES], "feature string")
    return types.union(known).distinct().select("feature", m.plain_name(F.col("feature")).alias("name"))


def benchmark_names(spark: SparkSession, d: str) -> DataFrame:
    """A gazetteer of up to four tokens: the entities, by pattern, of the benchmark's texts and of the questions."""
    texts = views.table(spark, d, "benchmark").select("text").unionByName(clean(spark, d).select(F.col("question").alias("text")))
    names = texts.select(F.explode(t.entities(F.col("text"))).alias("name")).distinct()
    return names.filter(F.size(t.found(F.col("name"), t.TOKEN)).between(1, 4))


@query
def c10_gazetteer(spark, d):
    """Mentions of the gazetteer's entities in answers."""
    return gazetteer.mentions(clean(spark, d), benchmark_names(spark, d), text_col="answer").withColumn("at", F.col("at").cast("long"))


@query
def d1_lexical(spark, d):
    return featured(spark, d, "lexical").select("sample_id", *ft.GROUPS["lexical"])


@query
def d3_numeric(spark, d):
    return featured(spark, d, "numeric").select("sample_id", *ft.GROUPS["numeric"])


@query
def d5_entity(spark, d):
    return featured(spark, d, "entity").select("sample_id", *ft.GROUPS["entity"])


@query
def d7_cosine(spark, d):
    vectors = views.table(spark, d, "embeddings")
    pairs = vectors.select("vec_id", (F.col("vec_id") + 1).alias("next_id"))
    return attach.vector_cosines(pairs.withColumnRenamed("vec_id", "pair_id"), vectors, "pair_id", "next_id").select(F.col("pair_id").alias("vec_id"), "cosine")


@query
def d8_tfidf_cosines(spark, d):
    """Cosines of TF-IDF vectors, their weights fitted on train rows."""
    from riskframe.plans.semantic import fit_tfidf, tfidf_cosines

    rows = records.stored(splits.with_split(clean(spark, d)), "samples")
    return tfidf_cosines(fit_tfidf(rows.filter("split = 'train'")), rows)


@query
def e1_attach_text(spark, d):
    rows = records.stored(clean(spark, d), "samples")
    texts, lengths = rows.select("sample_id", "question", "context", "answer"), ft.text_features(rows, ("length",)).select("sample_id", "n_words")
    attach.check_one_to_one(lengths, texts)
    return attach.attach(lengths, texts)


@query
def e2_attach_nli(spark, d):
    return attach.attach_nli(clean(spark, d), views.nli_scores(spark, d)).select("sample_id", *ft.GROUPS["nli"])


@query
def e2_missing_scores(spark, d):
    """Samples that the check of inference scores stops at."""
    return attach.missing_scores(attach.attach_nli(clean(spark, d), views.nli_scores(spark, d))).select("sample_id", "item_idx")


@query
def e3_alignment(spark, d):
    """Samples by whether their context is blank and whether scores reached them, by key and not by position."""
    df = attach.attach_nli(clean(spark, d), views.nli_scores(spark, d))
    return df.groupBy(t.is_blank(F.col("context")).alias("blank"), F.col("nli_ctx_entails_ans").isNotNull().alias("scored")).agg(F.count("*").alias("n"))


@query
def e4_group_split(spark, d):
    return splits.with_split(clean(spark, d)).select("sample_id", "split")


@query
def e5_core_features(spark, d):
    return featured(spark, d).select("sample_id", "item_idx", "label", *[f for g in (*ft.CORE, "entity") for f in ft.GROUPS[g]])


@query
def e6_pair_models(spark, d):
    df = predicted(spark, d)
    return stats.paired(df.select("sample_id", "label", "pred"), df.select("sample_id", F.col("pred_b").alias("pred")))


@query
def f1_group_split(spark, d):
    return splits.split_groups(clean(spark, d))


@query
def f1_lineitem_split(spark, d):
    return splits.split_groups(views.predictions(spark, d))


@query
def f2_folds(spark, d):
    return splits.folds(clean(spark, d)).select("sample_id", "fold")


@query
def f4_sample(spark, d):
    return splits.sample_n(clean(spark, d), 50, "sample_id").select("sample_id", "label")


@query
def f5_balanced_sample(spark, d):
    return splits.sample_each(clean(spark, d), 100, "label", "sample_id").select("sample_id", "label")


@query
def f6_error_sample(spark, d):
    return splits.sample_each(mistakes(spark, d), 10, "error_type", "sample_id").select("sample_id", "error_type")


@query
def f7_head(spark, d):
    return splits.head(clean(spark, d).select("sample_id", "label"), 20, "sample_id")


@query
def g1_label_balance(spark, d):
    return report.label_balance(clean(spark, d))


@query
def g2_integrity(spark, d):
    return splits.integrity(splits.with_split(clean(spark, d)))


@query
def g3_split_index(spark, d):
    return splits.split_index(splits.with_split(clean(spark, d)))


def mistakes(spark: SparkSession, d: str) -> DataFrame:
    return errors.errors(risky(spark, d)).withColumn("category", errors.category())


@query
def g4_error_pivot(spark, d):
    return errors.category_counts(mistakes(spark, d))


@query
def g5_over_seeds(spark, d):
    lines = views.table(spark, d, "lineitem")
    rows = lines.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("seed")).agg(F.round(F.sum("l_discount"), 6).alias("value"))
    return rounded(report.over_seeds(rows), 6, "mean", "std")


@query
def g6_manifest(spark, d):
    return report.manifest({n: views.table(spark, d, n) for n in TABLES})


def two_models(spark: SparkSession, d: str) -> DataFrame:
    df = predicted(spark, d)
    both = F.array(F.struct(F.lit("boosted_trees").alias("model"), F.col("pred").alias("p")), F.struct(F.lit("heuristic").alias("model"), F.col("pred_b").alias("p")))
    return df.select("label", F.inline(both)).withColumnRenamed("p", "pred")


@query
def g7_dashboard(spark, d):
    models = metrics.point_metrics(two_models(spark, d), ["model"]).select("model", "f1")
    df = predicted(spark, d)
    pairs = stats.mcnemar_counts(df.withColumnRenamed("pred", "pred_a"))
    out = report.dashboard(models, errors.cost(df), pairs)
    return rounded(out, 6, "f1", "cost_ratio")


@query
def g8_comparison(spark, d):
    return report.comparison(metrics.point_metrics(two_models(spark, d), ["model"]).select("model", "f1"))


@query
def h1_threshold_sweep(spark, d):
    return metrics.threshold_sweep(featured(spark, d, "lexical"), "overlap_answer_context")


@query
def h6_class_weight(spark, d):
    from riskframe.plans.models import class_weights

    return class_weights(clean(spark, d)).select("sample_id", "weight")


@query
def i1_point_metrics(spark, d):
    return metrics.point_metrics(predicted(spark, d))


@query
def i3_ranking(spark, d):
    return rounded(metrics.ranking_metrics(predicted(spark, d)), 9, "auroc", "pr_auc")


@query
def i5_ece(spark, d):
    return rounded(metrics.ece(predicted(spark, d)), 9, "ece")


@query
def i6_brier(spark, d):
    return rounded(metrics.brier(predicted(spark, d)), 9, "brier")


@query
def i7_reliability(spark, d):
    return rounded(metrics.reliability(predicted(spark, d)), 9, "confidence", "accuracy")


@query
def i8_curves(spark, d):
    return metrics.curve(predicted(spark, d))


@query
def i9_agreement(spark, d):
    return metrics.agreement(predicted(spark, d), "pred", "pred_b")


@query
def k1_mcnemar_predictions(spark, d):
    out = stats.mcnemar(predicted(spark, d).withColumnRenamed("pred", "pred_a"), "prediction")
    return rounded(out, 6, "p").select("b", "c", "statistic", "p")


@query
def k2_mcnemar_correctness(spark, d):
    out = stats.mcnemar(predicted(spark, d).withColumnRenamed("pred", "pred_a"))
    return rounded(out, 6, "p").withColumnRenamed("both", "both_right")


@query
def k2_mcnemar_by_group(spark, d):
    """The test within each line number."""
    rows = views.table(spark, d, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") >= 25).cast("int").alias("pred_a"), (F.col("l_discount") * 10 >= 0.5).cast("int").alias("pred_b"))
    return rounded(stats.mcnemar(rows, by=["l_linenumber"]), 6, "p").select("l_linenumber", "b", "c", "p")


@query
def k3_bootstrap(spark, d):
    return stats.bootstrap(predicted(spark, d))


@query
def k4_wilcoxon(spark, d):
    """Discount against tax, averaged by line number."""
    pairs = views.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return stats.wilcoxon(pairs)


@query
def k6_judge_report(spark, d):
    df = views.judge_replies(spark, d).withColumn("v", parse_reply(F.col("reply")))
    conf = (F.col("doc_id") % 9 + 1) / 10
    df = df.withColumns({"pred_judge": (F.col("v.judgment") == "hallucinated").cast("int"), "pred_model": (conf >= 0.5).cast("int")})
    out = stats.judge_report(df)
    return rounded(rounded(out, 9, "cost_usd", "cost_per_1000_usd"), 6, *[c for c in out.columns if c not in ("cost_usd", "cost_per_1000_usd", "n")])


def linear(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of a linear margin of given weights on four features."""
    from riskframe.plans.explain import linear_attributions

    df = featured(spark, d, "length", "lexical")
    means = df.agg(*[F.avg(c).alias(c) for c in LINEAR]).first().asDict()
    return linear_attributions(df, LINEAR, means)


@query
def l1_linear(spark, d):
    return rounded(linear(spark, d), 6, "impact")


@query
def l2_linear_importance(spark, d):
    from riskframe.plans.explain import global_importance

    return rounded(global_importance(linear(spark, d), 3), 6, "importance")


@query
def l3_linear_top(spark, d):
    from riskframe.plans.explain import local_top

    return local_top(rounded(linear(spark, d), 6, "impact"), 2)


@query
def l4_three_cases(spark, d):
    from riskframe.plans.explain import three_cases

    return three_cases(predicted(spark, d))


@query
def m1_errors(spark, d):
    return mistakes(spark, d).select("sample_id", "error_type", "category")


@query
def m3_cases(spark, d):
    from riskframe.plans.semantic import fit_tfidf, tfidf_cosines

    rows = records.stored(splits.with_split(clean(spark, d)), "samples")
    cosines = tfidf_cosines(fit_tfidf(rows.filter("split = 'train'")), rows)
    df = predicted_by_overlap(ft.slim_features(rows, views.nli_scores(spark, d), cosines))
    picked = errors.sample_each(errors.errors(df), 10, "error_type", "sample_id").select(df.columns)  # ten of each type at most
    out = errors.cases(rows.select("sample_id", *ft.TEXTS).join(F.broadcast(picked), "sample_id"))
    return out.select("*", F.col("features.n_words").alias("n_words"), F.col("features.overlap_answer_context").alias("overlap"), F.col("features.nli_ctx_entails_ans").alias("entails")).drop("features")


@query
def m4_summary(spark, d):
    return errors.summary(mistakes(spark, d))


@query
def m5_defaults(spark, d):
    return errors.with_defaults(featured(spark, d, "length")).select("sample_id", "n_words", "nli_ctx_neutral_ans", "cosine_q_ans", "n_sentences")


@query
def m6_latency(spark, d):
    return errors.latency(views.timings(spark, d))


@query
def m7_cost(spark, d):
    return errors.cost(clean(spark, d))


@query
def n1_validation(spark, d):
    from riskframe.plans.score import validated

    return validated(views.qa_turns(spark, d)).select("sample_id", "reason")


@query
def n4_judge_jobs(spark, d):
    from riskframe.plans.score import judged

    return judged(views.judge_replies(spark, d), "doc_id").drop("reasoning")


@query
def z2_unified(spark, d):
    qa = clean(spark, d).withColumn("task", F.lit("qa"))
    responses = records.normalise_responses(views.responses(spark, d)).withColumn("task", F.lit("response"))
    return qa.unionByName(responses, allowMissingColumns=True).select("sample_id", "task", "label")


def mappings() -> dict[str, unified.Mapping]:
    """How the given sources fill the unified schema."""
    c, flags = F.col, F.col("hallucination_labels_processed")
    texts = {"question": c("question"), "context": c("context"), "answer": c("answer")}
    risky = (F.coalesce(flags["evident_conflict"], F.lit(0)) > 0) | (F.coalesce(flags["baseless_info"], F.lit(0)) > 0)
    return {
        "qa": unified.Mapping("qa", {"sample_id": c("sample_id"), "source_group_id": c("item_idx"), "task": F.lit("qa"), **texts, "label": c("label")}, ("sample_id", "item_idx", "question", "context", "answer", "label")),
        "responses": unified.Mapping(
            "responses",
            {"sample_id": F.concat(F.lit("response_"), "id"), "source_group_id": c("id"), "task": F.lower("task_type"), "domain": c("query"), "context": c("context"), "answer": c("output"), "label": F.when(flags.isNotNull(), risky.cast("int"))},
            ("id", "task_type", "query", "context", "output", "hallucination_labels_processed"),
        ),
        "turns": unified.Mapping("turns", {"sample_id": c("sample_id"), "source_group_id": c("item_idx"), "task": F.lit("chat"), **texts}, ("sample_id", "item_idx", "question", "context", "answer")),
        "judge": unified.Mapping("judge", {"sample_id": F.concat(F.lit("judge_"), c("doc_id").cast("string")), "source_group_id": c("doc_id"), "answer": c("reply"), "label": c("label"), "generator": F.lit("judge")}, ("doc_id", "label", "reply")),
    }


def unified_sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"qa": clean(spark, d), "responses": views.responses(spark, d), "turns": views.qa_turns(spark, d), "judge": views.judge_replies(spark, d)}


@query
def z2_unified_schema(spark, d):
    """Samples of four sources in one schema; texts by their lengths."""
    out, how = None, mappings()
    for name, df in unified_sources(spark, d).items():
        part = unified.unified(df, how[name])
        out = part if out is None else out.unionByName(part)
    return out.select("source", "sample_id", "source_group_id", "task", "domain", *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("question", "context", "answer")], "label", F.size("spans").cast("long").alias("n_spans"), "generator")


@query
def z2_mapping_report(spark, d):
    out, how = None, mappings()
    for name, df in unified_sources(spark, d).items():
        part = unified.mapping_report(df, how[name])
        out = part if out is None else out.unionByName(part)
    return out


def by_status_and_discount(spark: SparkSession, d: str) -> DataFrame:
    lines = views.table(spark, d, "lineitem")
    return lines.select(F.concat_ws(":", "l_linestatus", F.round(F.col("l_discount") * 100).cast("int")).alias("subgroup"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 50).alias("prob"))


@query
def z3_recalibration(spark, d):
    """Intercept and slope of the log-odds within each line status and discount."""
    return rounded(metrics.recalibration(by_status_and_discount(spark, d), "subgroup", least=40), 6, "intercept", "slope")


@query
def z6_swaps(spark, d):
    """Answers whose figures, or names, are those of other answers."""
    df = clean(spark, d).select("sample_id", "answer")
    kinds = {"numbers": t.NUMBER, "names": perturb.NAME}
    parts = [perturb.swapped(df, pattern).select("sample_id", F.lit(kind).alias("kind"), "answer") for kind, pattern in kinds.items()]
    return parts[0].unionByName(parts[1])


@query
def z3_subgroup_calibration(spark, d):
    """Calibration within each line status and discount; groups of fewer than 40 rows take the figures of all rows."""
    return rounded(metrics.subgroup_calibration(by_status_and_discount(spark, d), "subgroup", least=40), 9, "ece", "brier", "nll")


@query
def z4_length_metrics(spark, d):
    """Accuracy by length of the answer, with the 95% interval of Wilson's formula."""
    df = risky(spark, d).withColumn("bucket", F.least(F.lit(4), F.expr("n_words div 10")))
    out = metrics.point_metrics(df, ["bucket"]).select("bucket", "accuracy").join(df.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    return rounded(out.select("*", *metrics.wilson_interval(F.col("accuracy"), F.col("n"))), 9, "low", "high")


@query
def z4_bootstrap_intervals(spark, d):
    """Accuracy by length of the answer, with bootstrap intervals."""
    df = risky(spark, d).select(F.least(F.lit(4), F.expr("n_words div 10")).alias("bucket"), "pred", "label")
    return rounded(stats.bootstrap_share(df, "bucket", F.col("pred") == F.col("label")), 9, "share")


@query
def z7_dedup(spark, d):
    key = F.lower(F.regexp_replace("answer", f"[{t.SPACE_CLASS}]+", " "))
    return clean(spark, d).groupBy(F.sha2(key, 256).alias("k")).agg(F.min("sample_id").alias("sample_id"), F.count("*").alias("copies")).drop("k")


