"""Leakage-free splits, folds and samples, all by hashed order under a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.sources.records import stored

SEED = 42
SLICE_DIGITS = 4


class LeakageError(ValueError):
    pass


def hashed(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def ranked(groups: DataFrame, key: str, strata: list[str], seed: int = SEED) -> DataFrame:
    """groups with rank (from 1) and total in each stratum's hashed order, counted over slices so that no stratum is one task.

    There are as many slices as rows up to 16**SLICE_DIGITS, each of a few rows or of a small share of them.
    """
    rows = groups.withColumn("_h", hashed(key, seed)).withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    sizes = rows.groupBy(*strata, "_slice").agg(F.count("*").alias("_n"))
    of = W.partitionBy(*strata, F.lit(1))
    offsets = sizes.select(
        *[F.col(s).alias(f"_g_{s}") for s in strata], F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(of.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(of).alias("total"),
    )
    same = F.col("_slice") == F.col("_s")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_g_{s}"))
    local = F.row_number().over(W.partitionBy(*strata, "_slice").orderBy("_h", key))
    return rows.withColumn("_local", local).join(offsets, same).select(*groups.columns, (F.col("_before") + F.col("_local")).alias("rank"), "total")


def group_labels(df: DataFrame, group: str = "item_idx") -> DataFrame:
    """(group, stratum): the largest label of each group; strata count only where there are several."""
    return df.groupBy(group).agg(F.max("label").alias("stratum"))


def split_groups(df: DataFrame, group: str = "item_idx", seed: int = SEED) -> DataFrame:
    """(group, split): 70/15/15 of each stratum's groups, never of rows."""
    order = ranked(group_labels(df, group), group, ["stratum"], seed)
    split = F.when(F.expr("100 * rank <= 70 * total"), "train").when(F.expr("100 * rank <= 85 * total"), "val").otherwise("test")
    return order.select(group, split.alias("split"))


def with_split(df: DataFrame, group: str = "item_idx", seed: int = SEED) -> DataFrame:
    return df.join(split_groups(df, group, seed), group)


def integrity(df: DataFrame, group: str = "item_idx") -> DataFrame:
    """One row for each split: groups, rows, mean label, and over all splits the groups, those in several, and leakage_free.

    What is counted is stored first, so that whatever makes the split runs once.
    """
    df = stored(df.select(group, "split", "label"), "split")
    per_group = df.groupBy(group).agg(F.count_distinct("split").alias("splits"))
    spanning = per_group.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum((F.col("splits") > 1).cast("long")), F.lit(0)).alias("spanning"))
    per_split = df.groupBy("split").agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows"), F.round(F.avg("label"), 4).alias("label_mean"))
    return per_split.crossJoin(F.broadcast(spanning)).withColumn("leakage_free", F.col("spanning") == 0)  # one row


def check_integrity(df: DataFrame, group: str = "item_idx") -> None:
    bad = df.groupBy(group).agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(5).collect()
    if bad:
        raise LeakageError(f"groups in several splits, such as {[r[0] for r in bad]}")


def split_index(df: DataFrame, group: str = "item_idx") -> DataFrame:
    """(split, group) rows, each once: the index as a table, which stays one at any size."""
    return df.select("split", group).distinct()


def folds(df: DataFrame, n: int = 5, by: str = "group", group: str = "item_idx", row: str = "sample_id", seed: int = SEED) -> DataFrame:
    """df with fold: whole groups stratified by their label, or single rows stratified by theirs."""
    if by == "group":
        fold = ranked(group_labels(df, group), group, ["stratum"], seed).select(group, ((F.col("rank") - 1) % n).cast("int").alias("fold"))
        return df.join(fold, group)
    return ranked(df, row, ["label"], seed).withColumn("fold", ((F.col("rank") - 1) % n).cast("int")).drop("rank", "total")


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement."""
    return df.withColumn("_h", hashed(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def sample_each(df: DataFrame, n: int, by: str, key: str, seed: int = SEED) -> DataFrame:
    """Up to n rows of each class."""
    order = W.partitionBy(by).orderBy("_h", key)
    return df.withColumn("_h", hashed(key, seed)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_h", "_r")


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)
