"""Entities of texts by a gazetteer: phrases of a table found in token order, longest first at each place, none overlapping.

Every place of a text whose token begins some phrase gives the phrases of the lengths that there are for that token, and these meet the
table in an equi-join. Token and phrase tables are stored before texts join them, so that adaptive execution can deal a common
first token or phrase to several tasks.

Defined results: null and empty texts have no mentions; phrases without tokens are found nowhere; phrases that differ only in
case or in what parts their tokens are one, under the first of their names; a phrase may be longer than a text; rows alike in key
share their mentions, so keys should be distinct.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.functions.text import TOKEN, found
from riskframe.sources.records import stored


def phrases(entities: DataFrame, name_col: str = "name") -> DataFrame:
    """(phrase, first, n, name): each entity as lower-case tokens joined by spaces, with its first token and their number; stored."""
    told = entities.select(F.col(name_col).alias("name"), found(F.lower(name_col), TOKEN).alias("ts")).filter(F.size("ts") > 0)
    whole = told.groupBy(F.array_join("ts", " ").alias("phrase")).agg(F.min("name").alias("name"), F.any_value("ts").alias("ts"))
    return stored(whole.select("phrase", F.col("ts")[0].alias("first"), F.size("ts").alias("n"), "name"), "phrases")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _kept(at: pd.Series, n: pd.Series) -> pd.Series:
    """Of ascending places with the lengths there, those that begin where no kept one before reaches."""

    def kept(places, lengths) -> list[bool]:
        out, end = [], 0
        for place, length in zip(places, lengths):
            out.append(bool(place >= end))
            end = place + length if place >= end else end
        return out

    return pd.Series([kept(a, b) for a, b in zip(at, n)])


def mentions(df: DataFrame, entities: DataFrame, key: str = "sample_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(key, at, n, name): the entities of each text from left to right, with the place of the first token and the number of tokens."""
    table = phrases(entities, name_col)
    starts = table.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    starts = stored(starts.withColumn("most", F.array_max("lengths")), "starts")
    rows = df.select(F.col(key).alias("_key"), found(F.lower(F.coalesce(text_col, F.lit(""))), TOKEN).alias("ts"))
    most = table.agg(F.coalesce(F.max("n"), F.lit(1)).alias("k"))  # one row
    places = rows.crossJoin(F.broadcast(most)).select("_key", F.expr("inline(transform(ts, (x, i) -> struct(i as at, slice(ts, i + 1, k) as ahead)))"))
    places = places.join(starts.hint("merge"), F.col("ahead")[0] == F.col("first")).select("_key", "at", "ahead", F.explode("lengths").alias("n"))
    places = places.filter(F.col("n") <= F.size("ahead")).select("_key", "at", "n", F.array_join(F.slice("ahead", 1, F.col("n")), " ").alias("phrase"))
    matched = places.join(table.select("phrase", "name").hint("merge"), "phrase").groupBy("_key", "at").agg(F.max(F.struct("n", "name")).alias("m"))
    each = matched.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", F.col("m.n").alias("n"), F.col("m.name").alias("name")))).alias("ms"))
    each = each.select("_key", "ms", _kept(F.col("ms.at"), F.col("ms.n")).alias("keep"))
    return each.select(F.col("_key").alias(key), F.inline(F.expr("transform(filter(arrays_zip(ms, keep), x -> x.keep), x -> x.ms)")))


def entity_sets(df: DataFrame, entities: DataFrame, sides: tuple[str, ...] = ("answer", "context"), key: str = "sample_id", name_col: str = "name") -> DataFrame:
    """df with ent_<side>, the distinct lower-case entities of each side, in the place of the pattern extractor's."""
    out = df
    for side in sides:
        found_here = mentions(df, entities, key, side, name_col).groupBy(key).agg(F.collect_set(F.lower("name")).alias(f"ent_{side}"))
        out = out.join(found_here, key, "left").withColumn(f"ent_{side}", F.coalesce(f"ent_{side}", F.array().cast("array<string>")))
    return out
