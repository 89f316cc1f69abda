"""Controlled changes of texts that take their material from the other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.text import found
from riskframe.operators.prefix import running
from riskframe.sources.records import stored

#: Capitalised words that follow each other.
NAME = r"\p{Lu}[\p{L}\p{N}_]*(?:\x20\p{Lu}[\p{L}\p{N}_]*)*"


def swapped(df: DataFrame, pattern: str, key: str = "sample_id", text_col: str = "answer", seed: int = 42) -> DataFrame:
    """df with every match of the pattern in its texts replaced by that of another place, no match staying what it was.

    Matches are ranked with equal ones side by side, in an order by hash, and each takes the match as many ranks on as the most
    frequent one has copies: the ranks of equal matches don't reach that far. A match that is more than half of all can't be replaced
    by others everywhere; the copies that have none are left as they are. Every match goes to one place, so the
    corpus keeps its values. keys must be distinct; rows without matches stay, null texts too.
    """
    places = df.select(F.col(key).alias("_key"), F.posexplode(found(F.col(text_col), pattern)).alias("_at", "_value"))
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), "_value")), F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string"), F.lit(":"), F.col("_at").cast("string"))))
    ranked = running(places.withColumn("_order", order).withColumn("_one", F.lit(1).cast("long")), "_order", ["_one"])
    ranked = stored(ranked.select("_key", "_at", "_value", F.col("before__one").alias("_rank"), F.col("all__one").alias("_n")), "ranked")
    shift = ranked.groupBy("_value").agg(F.count("*").alias("n")).agg(F.max("n").alias("_shift"))  # one row
    wanted = ranked.crossJoin(F.broadcast(shift)).select("_key", "_at", ((F.col("_rank") + F.col("_shift")) % F.col("_n")).alias("_rank"))
    taken = wanted.join(ranked.select("_rank", "_value"), "_rank")
    new = taken.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"]).alias("_new"))
    gaps = F.split(text_col, pattern, -1)
    text = F.array_join(F.zip_with(gaps, "_new", lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    out = df.join(new, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.when(F.col("_new").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in df.columns])
