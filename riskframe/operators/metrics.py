"""Metrics of predictions (label, prob): counts, ranking, calibration, curves, thresholds.

Rows are first collapsed to distinct scores, then summed in score order bucket by bucket (see prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.prefix import running
from riskframe.sources.records import stored

#: 0, 0.1, ... as linspace makes them.
EDGES = [i * 0.1 for i in range(10)] + [1.0]
THRESHOLDS = [i * 0.01 for i in range(100)] + [1.0]


def safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: list[str] = (), pred: str = "pred") -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return df.groupBy(*by).agg(
        count(f"{pred} = 1 and label = 1").alias("tp"), count(f"{pred} = 1 and label = 0").alias("fp"),
        count(f"{pred} = 0 and label = 1").alias("fn"), count(f"{pred} = 0 and label = 0").alias("tn"),
    )


def precision_recall_f1() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def mcc() -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc")


def point_metrics(df: DataFrame, by: list[str] = (), pred: str = "pred") -> DataFrame:
    """precision, recall, f1, mcc, accuracy; each 0 where it isn't defined."""
    accuracy = safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy")
    return confusion(df, by, pred).select(*by, *precision_recall_f1(), mcc(), accuracy)


def by_score(df: DataFrame, prob: str = "prob", by: list[str] = ()) -> DataFrame:
    """(by, score, pos, neg, before_*, all_*) from the highest score down."""
    pos = F.sum(F.col("label").cast("long"))
    counts = df.groupBy(*by, F.col(prob).alias("score")).agg(pos.alias("pos"), (F.count("*") - pos).alias("neg"))
    return running(counts, "score", ["pos", "neg"], list(by), descending=True)


def ranking_metrics(df: DataFrame, prob: str = "prob", by: list[str] = ()) -> DataFrame:
    """auroc with ties averaged (null with one class), and pr_auc as average precision."""
    won = F.sum(F.col("neg").cast("double") * (F.col("before_pos") + F.col("pos") / 2))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    seen_pos = F.col("before_pos") + F.col("pos")
    step = F.sum(F.col("pos").cast("double") / F.greatest(F.col("all_pos"), F.lit(1)) * seen_pos / (seen_pos + F.col("before_neg") + F.col("neg")))
    return by_score(df, prob, by).groupBy(*by).agg(F.try_divide(won, pairs).alias("auroc"), step.alias("pr_auc"))


def curve(df: DataFrame, prob: str = "prob") -> DataFrame:
    """(score, tpr, fpr, precision, recall): a point of the ROC and the precision-recall curve for each distinct score."""
    pos, neg = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return by_score(df, prob).select("score", safe(pos, F.col("all_pos")).alias("tpr"), safe(neg, F.col("all_neg")).alias("fpr"), safe(pos, pos + neg).alias("precision"), safe(pos, F.col("all_pos")).alias("recall"))


def bin_of(p: Column) -> Column:
    """Number of the equal-width bin, edges belonging to the bin above."""
    above = sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in EDGES), F.lit(0))
    return F.least(F.lit(9), F.greatest(F.lit(0), above - 1))


def reliability(df: DataFrame, prob: str = "prob", by: list[str] = ()) -> DataFrame:
    """(bin, n, confidence, accuracy); empty bins have no row."""
    return df.groupBy(*by, bin_of(F.col(prob)).alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("confidence"), F.avg("label").alias("accuracy"))


def ece(df: DataFrame, prob: str = "prob", by: list[str] = ()) -> DataFrame:
    bins = reliability(df, prob, by)
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, prob: str = "prob", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(prob) - F.col("label"), 2)).alias("brier"))


def nll(df: DataFrame, prob: str = "prob", by: list[str] = (), least: float = 1e-6) -> DataFrame:
    """Mean negative log-likelihood, probabilities kept least away from 0 and 1."""
    p = F.least(F.lit(1 - least), F.greatest(F.lit(least), F.col(prob)))
    return df.groupBy(*by).agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))).alias("nll"))


def subgroup_calibration(df: DataFrame, group: str, least: int = 30) -> DataFrame:
    """(group, n, pooled, ece, brier, nll, worst) of each group; groups of fewer than least rows are pooled: they take the figures
    of all rows. worst marks the group of largest ECE among those that aren't, the first by name on ties."""
    def figures(by: list[str]) -> DataFrame:
        parts = [df.groupBy(*by).agg(F.count("*").alias("n")), ece(df, by=by), brier(df, by=by), nll(df, by=by)]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, by) if by else out.crossJoin(F.broadcast(part))  # one row each
        return out

    every = figures([]).select(*[F.col(c).alias(f"all_{c}") for c in ("ece", "brier", "nll")])
    own = stored(figures([group]), "subgroups")
    worst = own.filter(F.col("n") >= least).agg(F.min_by(group, F.struct(-F.col("ece"), F.col(group))).alias("worst_group"))
    pooled = F.col("n") < least
    out = own.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(worst))  # one row each
    return out.select(group, "n", pooled.alias("pooled"), *[F.when(pooled, F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in ("ece", "brier", "nll")], F.coalesce(F.col(group) == F.col("worst_group"), F.lit(False)).alias("worst"))


#: Rounds of Newton's method, and the step below which all groups count as settled.
ROUNDS, SETTLED = 25, 1e-9


def recalibration(df: DataFrame, group: str, prob: str = "prob", least: int = 30, clip: float = 1e-6) -> DataFrame:
    """(group, n, pooled, intercept, slope): logistic recalibration of the log-odds of prob within each group, fitted for all groups at once.

    Rows are counted by group, log-odds and label first. Each round of Newton's method is one aggregation of gradients and
    Hessians over these cells and one small table of parameters, which is stored; all begin at 0, where no row is certain. Groups of fewer than least rows are pooled: they take
    the fit of all rows, and rows without a group count there only. A group whose fit has no finite answer (one label alone, or labels that
    a score parts) has nulls. Runs jobs while the plan is built.
    """
    p = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(prob)))
    rows = df.select(F.col(group).alias("g"), F.log(p / (1 - p)).alias("x"), F.col("label").cast("double").alias("y"))
    rows = rows.select("x", "y", "g", F.explode(F.array(F.lit(False), F.lit(True))).alias("every")).withColumn("g", F.when(~F.col("every"), F.col("g")))
    cells = stored(rows.filter("every or g is not null").groupBy("every", "g", "x", "y").agg(F.count("*").alias("n")), "cells")
    same = F.expr("every = p_every and g <=> p_g")
    fits = cells.groupBy("every", "g").agg(F.sum("n").alias("n"), F.count_distinct("y").alias("labels"), F.count_distinct("x").alias("scores"))
    fits = stored(fits.select(F.col("every").alias("p_every"), F.col("g").alias("p_g"), "n", *[F.when(F.expr("labels = 2 and scores > 1"), F.lit(v)).alias(c) for c, v in (("a", 0.0), ("b", 0.0))], F.lit(1.0).alias("step")), "fits")
    for _ in range(ROUNDS):
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        each = cells.join(fits.select("p_every", "p_g", "a", "b").filter("a is not null").hint("merge"), same)
        each = each.withColumn("r", F.col("n") * (F.col("y") - q)).withColumn("h", F.col("n") * q * (1 - q))
        total = lambda e: F.sum(F.expr(e))
        sums = each.groupBy("every", "g").agg(*[total(e).alias(c) for c, e in (("g0", "r"), ("g1", "r * x"), ("h0", "h"), ("h1", "h * x"), ("h2", "h * x * x"))])
        det = F.expr("h0 * h2 - h1 * h1")
        sums = sums.withColumn("da", F.try_divide(F.expr("h2 * g0 - h1 * g1"), det)).withColumn("db", F.try_divide(F.expr("h0 * g1 - h1 * g0"), det))
        sums = sums.withColumn("size", F.expr("sqrt(da * da + db * db)")).withColumn("part", F.least(F.lit(1.0), F.try_divide(F.lit(4.0), "size")))
        sums = sums.select("every", "g", *[(F.col("part") * F.col(f"d{c}")).alias(f"d{c}") for c in "ab"], F.col("size"))
        fits = stored(fits.join(sums, same, "left").select("p_every", "p_g", "n", (F.col("a") + F.col("da")).alias("a"), (F.col("b") + F.col("db")).alias("b"), F.col("size").alias("step")), "fits")
        if (fits.agg(F.max("step")).first()[0] or 0.0) < SETTLED:
            break
    settled = F.col("step") < 1e-6
    fits = fits.select("p_every", "p_g", "n", *[F.when(settled, F.col(c)).alias(name) for c, name in (("a", "intercept"), ("b", "slope"))])
    pool = fits.filter("p_every").select(*[F.col(c).alias(f"all_{c}") for c in ("intercept", "slope")])  # one row
    pooled = F.col("n") < least
    out = fits.filter("not p_every").crossJoin(F.broadcast(pool))
    return out.select(F.col("p_g").alias(group), "n", pooled.alias("pooled"), *[F.when(pooled, F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in ("intercept", "slope")])


def wilson_interval(share: Column, n: Column, z: float = 1.959963984540054) -> list[Column]:
    """low and high of a share among n, at 95% by default."""
    centre, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return [((centre - spread) / (1 + z * z / n)).alias("low"), ((centre + spread) / (1 + z * z / n)).alias("high")]


def agreement(df: DataFrame, a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def threshold_sweep(df: DataFrame, overlap: str = "overlap") -> DataFrame:
    """(threshold, f1) for risk where overlap < threshold: rows are counted once, at the first threshold above their overlap."""
    # Thresholds up to the overlap: all that are clearly below it, and the few beside it by comparison with their exact values.
    low = F.greatest(F.lit(0), F.floor(F.col(overlap) * (len(THRESHOLDS) - 1)) - 1)
    at = lambda j: F.when(low + j >= len(THRESHOLDS) - 1, F.lit(THRESHOLDS[-1])).otherwise((low + j) * THRESHOLDS[1])
    first = (low + sum((F.when((low + j < len(THRESHOLDS)) & (at(j) <= F.col(overlap)), 1).otherwise(0) for j in range(4)), F.lit(0))).cast("int")
    counts = df.groupBy(first.alias("at")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))
    counts = stored(counts, "counts")  # at most 102 rows; the rows themselves are read once
    grid = df.sparkSession.createDataFrame(list(enumerate(THRESHOLDS)), "k int, threshold double")
    each = grid.join(F.broadcast(counts), F.col("at") <= F.col("k"), "left")  # 101 rows with 102
    total = counts.agg(F.sum("pos").alias("total"))
    summed = each.groupBy("k", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return summed.crossJoin(F.broadcast(total)).select("threshold", safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.coalesce("total", F.lit(0))).alias("f1"))  # one row


def best_threshold(df: DataFrame, overlap: str = "overlap", none_at: float = 0.0) -> DataFrame:
    """(threshold, f1): the lowest of the best thresholds; none_at where every F1 is 0."""
    best = threshold_sweep(df, overlap).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, -F.col("b.t")).otherwise(none_at).alias("threshold"), F.col("b.f1").alias("f1"))


def full_report(df: DataFrame, prob: str = "prob", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """One row (for each value of by) with all metrics. What is measured is stored first, so that a model before it scores once."""
    by = list(by)
    df = stored(df.select(*by, "label", *dict.fromkeys((prob, pred))), "scored")
    parts = [point_metrics(df, by, pred), ranking_metrics(df, prob, by), ece(df, prob, by), brier(df, prob, by)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by) if by else out.crossJoin(F.broadcast(part))  # one row each
    return out
