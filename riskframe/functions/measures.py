"""Set, number and vector measures, and labels of scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Lower limits of the labels, highest first.
RISK_LEVELS = ((0.70, "high_risk"), (0.30, "medium_risk"))
BANDS = ((70, "high"), (30, "medium"))
#: Plain names of features.
PLAIN_NAMES = {
    "overlap_answer_context": "Context Overlap",
    "overlap_answer_question": "Question Overlap",
    "jaccard_ans_ctx": "Jaccard Similarity",
    "jaccard_ans_q": "Question Jaccard",
    "n_numbers_answer": "Answer Numbers Count",
    "n_numbers_context": "Context Numbers Count",
    "number_overlap_ratio": "Number Overlap Ratio",
    "novel_numbers": "Novel Numbers Found",
    "hedge_count": "Hedge Phrase Count",
    "hedge_density": "Hedge Density",
    "n_words": "Answer Word Count",
    "n_chars": "Answer Character Count",
    "n_sentences": "Sentence Count",
    "avg_word_len": "Avg Word Length",
}


def size(items: Column) -> Column:
    return F.size(items).cast("long")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or empty where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.try_divide(part.cast("double"), whole))


def common(mine: Column, other: Column) -> Column:
    """Number of items that two sets share."""
    return F.size(F.array_intersect(mine, other)).cast("long")


def overlap(shared: Column, mine: Column) -> Column:
    """Share of my items that are shared; 0 without items."""
    return ratio(shared, mine, 0.0)


def jaccard(shared: Column, mine: Column, other: Column) -> Column:
    """Of the numbers of shared, my and other items."""
    return F.when(mine == 0, F.lit(0.0)).otherwise(ratio(shared, mine + other - shared, 0.0))


def supported(shared: Column, mine: Column) -> Column:
    """Share of my items that are shared; 1 without items, since nothing then lacks support."""
    return ratio(shared, mine, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine to six places, 0 where a length is 0."""
    return F.bround(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)), 6)


def clamp(p: Column) -> Column:
    return F.least(F.lit(0.999), F.greatest(F.lit(0.001), p))


def risk_label(p: Column) -> Column:
    """Label of a clamped score that isn't rounded."""
    (high, a), (medium, b) = RISK_LEVELS
    return F.when(p >= high, a).when(p >= medium, b).otherwise("low_risk")


def display_band(p: Column, label: Column | None = None) -> Column:
    """Band by the rounded percentage, which can differ from the label; a label that is there decides."""
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.round(p * 100)))
    (high, a), (medium, b) = BANDS
    band = F.when(percent >= high, a).when(percent >= medium, b).otherwise("low")
    return band if label is None else F.coalesce(F.regexp_replace(label, "_risk$", ""), band)


def plain_name(feature: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PLAIN_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, feature), feature)
