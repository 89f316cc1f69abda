"""One schema for samples of all sources, and a report of what each source had for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The declared schema: type and default of each column; None where there is no default to give.
TARGET: dict[str, tuple[str, object]] = {
    "sample_id": ("string", None), "source_group_id": ("string", ""), "task": ("string", "other"), "domain": ("string", "general"),
    "question": ("string", ""), "context": ("string", ""), "answer": ("string", ""), "label": ("int", None),
    "spans": ("array<struct<start: long, stop: long>>", ()), "generator": ("string", "unknown"),
}


@dataclass
class Mapping:
    """How a source fills the schema: the columns it has, and the names of its own columns that go into them."""

    source: str
    columns: dict[str, Column]
    used: tuple[str, ...]


def _default(name: str) -> Column:
    kind, value = TARGET[name]
    return F.array().cast(kind) if value == () else F.lit(value).cast(kind)


def unified(df: DataFrame, mapping: Mapping) -> DataFrame:
    """df in the declared schema, with the name of its source; what it lacks, as column or as value, is at its default."""
    made = {c: F.coalesce(mapping.columns[c].cast(kind), _default(c)) if c in mapping.columns else _default(c) for c, (kind, _) in TARGET.items()}
    return df.select(F.lit(mapping.source).alias("source"), *[x.alias(c) for c, x in made.items()])


def mapping_report(df: DataFrame, mapping: Mapping) -> DataFrame:
    """(source, column, mapped, defaulted, dropped): for each column of the schema the rows that have a value of the source's and
    those at the default, and for each column of the source that goes nowhere its values."""
    n = lambda c: F.count(F.when(c, 1))
    gone = [c for c in df.columns if c not in mapping.used]
    rows = [F.struct(F.lit(c).alias("column"), (n(mapping.columns[c].isNotNull()) if c in mapping.columns else n(F.lit(False))).alias("mapped"), F.lit(False).alias("lost")) for c in TARGET]
    rows += [F.struct(F.lit(c).alias("column"), n(F.col(f"`{c}`").isNotNull()).alias("mapped"), F.lit(True).alias("lost")) for c in gone]
    counted = df.agg(F.count("*").alias("rows"), F.array(*rows).alias("counts")).select("rows", F.inline("counts"))
    value = lambda c: F.when(c, F.col("mapped")).otherwise(F.lit(0))
    return counted.select(
        F.lit(mapping.source).alias("source"), "column", value(~F.col("lost")).alias("mapped"),
        F.when(F.col("lost"), F.lit(0)).otherwise(F.col("rows") - F.col("mapped")).alias("defaulted"), value(F.col("lost")).alias("dropped"),
    )
