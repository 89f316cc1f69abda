"""Running sums and exact ranks over a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from riskframe.sources.records import stored

def bucketed(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """df, stored, with ``_bucket``: a number that rises with the order column; equal values share one.

    Buckets are range partitions, as many as the session shuffles to, so that they grow in number with the cluster and the data.
    """
    ranges = df.repartitionByRange(order) if buckets is None else df.repartitionByRange(buckets, order)
    return stored(ranges.withColumn("_bucket", F.spark_partition_id()), "bucketed")


def running(df: DataFrame, order: str, sums: list[str], groups: list[str] = (), descending: bool = False, buckets: int | None = None) -> DataFrame:
    """df with ``before_<c>`` and ``all_<c>`` for each summed column: its total over earlier rows of the group, and over all.

    Rows must be distinct in groups and order. Windows see one bucket of a group at a time; bucket totals are few.
    """
    rows = bucketed(df, order, buckets)
    groups = list(groups)
    by = lambda c: F.desc(c) if descending else F.asc(c)
    totals = rows.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.partitionBy(*groups, F.lit(1)).orderBy(by("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups, F.lit(1))
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    here = W.partitionBy(*groups, "_bucket").orderBy(by(order)).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("_bucket") == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = rows.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_w_{c}") for c in sums])
    joined = inner.join(offsets, same)
    return joined.select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def exact_quantiles(df: DataFrame, value: str, shares: list[float], groups: list[str] = ()) -> DataFrame:
    """(groups, share, quantile): linearly interpolated quantiles, exact, from ranks of distinct values."""
    groups = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("n"))
    ranked = running(counts, "_v", ["n"], groups)
    wanted = ranked.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.col("share") * (F.col("all_n") - 1))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda r: (F.col("before_n") <= r) & (r < F.col("before_n") + F.col("n"))
    near = wanted.filter(holds(low) | holds(high))
    out = near.groupBy(*groups, "share").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("at").alias("at"))
    return out.select(*groups, "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile"))
