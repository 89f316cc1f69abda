"""Errors of a model: selection, taxonomy, samples, counts, latency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.prefix import exact_quantiles
from riskframe.operators.splits import sample_each

#: The categories in alphabetical order.
CATEGORIES = ("entity_extraction_failure", "label_ambiguity", "other", "short_answer_ambiguity", "unsupported_but_semantically_similar", "weak_context")
THIRD = 1 / 3
#: What stands for a missing feature.
DEFAULTS = {
    "n_chars": 0, "n_words": 0, "n_sentences": 1, "avg_word_len": 0.0,
    "overlap_answer_context": 0.0, "overlap_answer_question": 0.0, "jaccard_ans_ctx": 0.0, "jaccard_ans_q": 0.0,
    "n_entities_answer": 0, "n_entities_context": 0, "entity_overlap_ratio": 1.0, "novel_entity_ratio": 0.0,
    "nli_ctx_entails_ans": THIRD, "nli_ctx_contradicts_ans": THIRD, "nli_ctx_neutral_ans": THIRD,
    "nli_ans_entails_ctx": THIRD, "nli_ans_contradicts_ctx": THIRD, "nli_ans_neutral_ctx": THIRD,
    "n_numbers_answer": 0, "n_numbers_context": 0, "number_overlap_ratio": 1.0, "novel_numbers": 0,
    "hedge_count": 0, "hedge_density": 0.0, "cosine_ctx_ans": 0.0, "cosine_q_ans": 0.0,
}
#: Dollars for 1,000 predictions.
COST_PER_1000 = {"local": 0.001, "llm_judge": 0.11}


def error_type() -> Column:
    return F.when(F.expr("pred = 1 and label = 0"), "false_positive").when(F.expr("pred = 0 and label = 1"), "false_negative")


def errors(df: DataFrame) -> DataFrame:
    """Rows whose prediction (0 or 1) isn't their label: one comparison, so that a filter that is worked out before the features has them once."""
    return df.filter(F.col("pred") != F.col("label")).withColumn("error_type", error_type())


def value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def category() -> Column:
    """First rule that holds, in this order."""
    words, overlap = value("n_words"), value("overlap_answer_context")
    contra, entail = value("nli_ctx_contradicts_ans"), value("nli_ctx_entails_ans")
    long = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return (
        F.when(words <= 4, "short_answer_ambiguity")
        .when((entail > 0.8) & (overlap > 0.6) | (contra > 0.5) & (overlap < 0.3), "label_ambiguity")
        .when(value("n_entities_answer") == 0, "entity_extraction_failure")
        .when(long("context") < 80, "weak_context")
        .when((long("answer") < 40) & (words <= 8), "short_answer_ambiguity")
        .when(overlap > 0.6, "unsupported_but_semantically_similar")
        .otherwise("other")
    )


def cases(df: DataFrame, most: int = 10) -> DataFrame:
    """Up to most errors of each type, with shortened texts and the features that explain them as a struct."""
    four = lambda c: F.bround(value(c), 4).alias(c)
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    picked = sample_each(errors(df), most, "error_type", "sample_id")
    return picked.select(
        "sample_id", "error_type", F.col("label").alias("true_label"), F.col("pred").alias("predicted_label"), F.bround("prob", 4).alias("probability"), category().alias("category"),
        text("question", 300), text("context", 400), text("answer", 300),
        F.struct(value("n_words").alias("n_words"), *[four(c) for c in ("overlap_answer_context", "nli_ctx_contradicts_ans", "nli_ctx_entails_ans")], value("n_entities_answer").alias("n_entities_answer"), four("entity_overlap_ratio"), four("cosine_ctx_ans")).alias("features"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    """Error types by categories, zeros filled in."""
    return df.groupBy("error_type").pivot("category", list(CATEGORIES)).count().na.fill(0)


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((F.col("error_type") == t).cast("long")), F.lit(0)).alias(f"n_{t}") for t in ("false_positive", "false_negative")])


def with_defaults(df: DataFrame) -> DataFrame:
    """df with every feature there, missing columns and nulls at their default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()})


def latency(timings: DataFrame) -> DataFrame:
    """(component, p50, p95, mean) in ms to two places, and the median of each sample's total as component ``total``."""
    q = exact_quantiles(timings, "ms", [0.5, 0.95], ["component"]).groupBy("component").agg(F.min("quantile").alias("p50"), F.max("quantile").alias("p95"))
    mean = timings.groupBy("component").agg(F.avg("ms").alias("mean"))
    total = exact_quantiles(timings.groupBy("sample_id").agg(F.sum("ms").alias("ms")), "ms", [0.5])
    total = total.select(F.lit("total").alias("component"), F.col("quantile").alias("p50"), F.lit(None).cast("double").alias("p95"), F.lit(None).cast("double").alias("mean"))
    return q.join(mean, "component").unionByName(total).select("component", *[F.round(c, 2).alias(c) for c in ("p50", "p95", "mean")])


def cost(df: DataFrame) -> DataFrame:
    """(way, rows, cost_usd): what scoring df costs each way."""
    ways = F.array(*[F.struct(F.lit(w).alias("way"), F.lit(c).alias("usd")) for w, c in COST_PER_1000.items()])
    return df.agg(F.count("*").alias("rows")).select("rows", F.inline(ways)).select("way", "rows", (F.col("rows") / 1000 * F.col("usd")).alias("cost_usd"))
