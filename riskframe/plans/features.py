"""The feature table: one projection for all groups that come from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions import measures as m, text as t
from riskframe.functions.text import is_blank
from riskframe.operators.attach import attach_nli
from riskframe.operators.errors import DEFAULTS

#: Groups and order of the features.
GROUPS = {
    "length": ["n_chars", "n_words", "n_sentences", "avg_word_len"],
    "lexical": ["overlap_answer_context", "overlap_answer_question", "jaccard_ans_ctx", "jaccard_ans_q"],
    "entity": ["n_entities_answer", "n_entities_context", "entity_overlap_ratio", "novel_entity_ratio"],
    "nli": [
        "nli_ctx_entails_ans", "nli_ctx_contradicts_ans", "nli_ctx_neutral_ans",
        "nli_ans_entails_ctx", "nli_ans_contradicts_ctx", "nli_ans_neutral_ctx",
    ],
    "numeric": ["n_numbers_answer", "n_numbers_context", "number_overlap_ratio", "novel_numbers"],
    "hedging": ["hedge_count", "hedge_density"],
    "semantic": ["cosine_ctx_ans", "cosine_q_ans"],
}
CORE = ("length", "lexical", "numeric", "hedging")
TEXTS = ("question", "context", "answer")


#: Sets that the groups are measured on: texts whose sets are made, and pairs whose common items are counted.
SETS = {"lexical": ("tok", TEXTS, ("context", "question")), "numeric": ("num", TEXTS[1:], ("context",)), "entity": ("ent", TEXTS[1:], ("context",))}


def tokenised(df: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """df with the token, number and entity sets that the groups need: each made once."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS}
    make = {"tok": t.tokens, "num": t.numbers, "ent": t.entities}
    sets = {}
    for group, (kind, sides, _) in SETS.items():
        if group in groups and f"{kind}_answer" not in df.columns:
            sets |= {f"{kind}_{side}": make[kind](F.col(side)) for side in sides}
    if "ent_context" in sets:
        sets["ent_context"] = F.when(t.is_blank(F.col("context")), F.array().cast("array<string>")).otherwise(sets["ent_context"])
    return df.withColumns(texts).withColumns(sets)


def counted(df: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """df with the numbers that the groups' ratios are made of, each worked out once: words, hedges, sizes of sets and of what they share."""
    made = {"_words": t.n_words(F.col("answer"))}
    if "hedging" in groups:
        made["_hedges"] = t.hedge_count(F.col("answer"))
    for group, (kind, sides, pairs) in SETS.items():
        if group in groups:
            made |= {f"_{kind}_{side}": m.size(F.col(f"{kind}_{side}")) for side in sides}
            made |= {f"_{kind}_answer_{side}": m.common(F.col(f"{kind}_answer"), F.col(f"{kind}_{side}")) for side in pairs}
    return tokenised(df, groups).withColumns(made)


def text_features(df: DataFrame, groups: tuple[str, ...] = (*CORE, "entity")) -> DataFrame:
    """df (question, context, answer and others) with the features of the groups."""
    c = F.col
    per_word = lambda n: n / F.greatest(F.lit(1), c("_words"))
    made = {
        "n_chars": F.length("answer").cast("long"), "n_words": c("_words"), "n_sentences": t.n_sentences(c("answer")), "avg_word_len": per_word(F.length("answer")),
        "overlap_answer_context": m.overlap(c("_tok_answer_context"), c("_tok_answer")), "overlap_answer_question": m.overlap(c("_tok_answer_question"), c("_tok_answer")),
        "jaccard_ans_ctx": m.jaccard(c("_tok_answer_context"), c("_tok_answer"), c("_tok_context")), "jaccard_ans_q": m.jaccard(c("_tok_answer_question"), c("_tok_answer"), c("_tok_question")),
        "n_entities_answer": c("_ent_answer"), "n_entities_context": c("_ent_context"),
        "entity_overlap_ratio": F.bround(m.supported(c("_ent_answer_context"), c("_ent_answer")), 6),
        "novel_entity_ratio": F.bround(m.ratio(c("_ent_answer") - c("_ent_answer_context"), c("_ent_answer"), 0.0), 6),
        "n_numbers_answer": c("_num_answer"), "n_numbers_context": c("_num_context"),
        "number_overlap_ratio": m.supported(c("_num_answer_context"), c("_num_answer")), "novel_numbers": c("_num_answer") - c("_num_answer_context"),
        "hedge_count": c("_hedges"), "hedge_density": per_word(c("_hedges")),
    }
    kept = [f for g in GROUPS if g in groups for f in GROUPS[g] if f in made]
    return counted(df, groups).select(*df.columns, *[made[f].alias(f) for f in kept])


def full_features(samples: DataFrame, nli: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Text features, with inference scores and cosines (sample_id, cosine_ctx_ans, cosine_q_ans) where there are tables of them."""
    out = text_features(samples)
    if nli is not None:
        out = attach_nli(out, nli)
    return out if semantic is None else out.join(semantic, "sample_id", "left")


def slim_features(samples: DataFrame, nli: DataFrame, semantic: DataFrame) -> DataFrame:
    """full_features() without the texts, which no join moves; of the context there remains, until scores are joined, whether it is blank."""
    mark = F.when(is_blank(F.col("context")), F.lit("")).otherwise(F.lit("."))
    rest = text_features(samples).withColumn("context", mark).drop("question", "answer")
    return attach_nli(rest, nli).drop("context").join(semantic, "sample_id", "left")


def columns_of(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    """Feature columns of the groups that df has in full."""
    found = [f for g, fs in GROUPS.items() if (groups is None or g in groups) and all(f in df.columns for f in fs) for f in fs]
    if not found:
        raise ValueError("no feature group is there in full")
    return found


def readiness(df: DataFrame, contract: list[str]) -> DataFrame:
    """One row: number of features the contract names, those missing, and whether df is ready."""
    missing = [c for c in contract if c not in df.columns]
    return df.sparkSession.createDataFrame([(len(contract), missing, not missing)], "n_features int, missing array<string>, ready boolean")


ALL_FEATURES = list(DEFAULTS)
