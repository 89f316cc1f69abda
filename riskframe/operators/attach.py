"""Joins that bring texts, scores, entities and vectors to samples, by key and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.measures import cosine
from riskframe.functions.text import is_blank

CLASSES = ("contradiction", "entailment", "neutral")


class AlignmentError(ValueError):
    pass


def attach(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of left with the columns of right, one to one."""
    return left.join(right, key)


def check_one_to_one(left: DataFrame, right: DataFrame, key: str = "sample_id") -> None:
    for name, one, other in (("right", left, right), ("left", right, left)):
        if one.join(other, key, "left_anti").limit(1).count():
            raise AlignmentError(f"keys without a row on the {name}")
        if one.groupBy(key).count().filter("count > 1").limit(1).count():
            raise AlignmentError("a key has several rows")


def attach_nli(samples: DataFrame, scores: DataFrame, key: str = "item_idx") -> DataFrame:
    """samples with six probabilities: 1/3 each where the context is blank, else those of the table, to six places; a
    sample with a context but no scores keeps nulls for check_nli to find."""
    joined = samples.join(scores, key, "left")
    blank = is_blank(F.col("context"))
    p = lambda c: F.bround(F.when(blank, F.lit(1 / 3)).otherwise(F.col(c)), 6)
    return joined.select(
        *samples.columns,
        p("ctx_entailment").alias("nli_ctx_entails_ans"), p("ctx_contradiction").alias("nli_ctx_contradicts_ans"), p("ctx_neutral").alias("nli_ctx_neutral_ans"),
        p("ans_entailment").alias("nli_ans_entails_ctx"), p("ans_contradiction").alias("nli_ans_contradicts_ctx"), p("ans_neutral").alias("nli_ans_neutral_ctx"),
    )


def missing_scores(df: DataFrame) -> DataFrame:
    """Rows that have a context but no inference scores in one direction or both."""
    return df.filter("nli_ctx_entails_ans is null or nli_ans_entails_ctx is null")


def check_nli(df: DataFrame) -> None:
    if missing_scores(df).limit(1).count():
        raise AlignmentError("samples without inference scores")


def attach_entities(samples: DataFrame, entities: DataFrame) -> DataFrame:
    """samples with ent_answer and ent_context from (sample_id, side, entity) rows."""
    low = F.lower("entity")
    sets = entities.groupBy("sample_id").agg(*[F.collect_set(F.when(F.col("side") == side, low)).alias(f"ent_{side}") for side in ("answer", "context")])
    empty = F.array().cast("array<string>")
    return samples.join(sets, "sample_id", "left").withColumns({f"ent_{s}": F.coalesce(f"ent_{s}", empty) for s in ("answer", "context")})


def vector_cosines(pairs: DataFrame, vectors: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the cosine of two ids' vectors; ids without a vector count as zero vectors."""
    a, b = (vectors.select(F.col("vec_id").alias(f"_{s}"), F.col("embedding").alias(f"_v{s}")) for s in "ab")
    joined = pairs.join(a, F.col(left) == F.col("_a"), "left").join(b, F.col(right) == F.col("_b"), "left")
    return joined.select(*pairs.columns, F.when(F.col("_va").isNull() | F.col("_vb").isNull(), F.lit(0.0)).otherwise(cosine(F.col("_va"), F.col("_vb"))).alias("cosine"))


def provenance(samples: DataFrame, scores: DataFrame, source: str, key: str = "item_idx") -> DataFrame:
    """One row: where inference scores come from, the order of their classes, and how many samples have them."""
    matched = samples.join(scores.select(key, F.lit(1).alias("_scored")), key, "left")
    return matched.agg(F.count("*").alias("samples"), F.count("_scored").alias("scored")).select(
        F.lit(source).alias("source"), F.lit(",".join(CLASSES)).alias("class_order"), F.lit(2).alias("directions"), "samples", "scored"
    )
