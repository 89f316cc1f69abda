"""From documents to shards of a training mix: each stage works on all that the one before kept.

Every stage but the last returns the columns of documents, whatever else they are; the mix repeats the rows it draws more
than once. Near duplicates share 0.8 of their five-word shingles. Defined results: null and empty texts, and texts without words,
are scored like any, are no one's near duplicate, are never contaminated and take no words of the mix; very long texts are read
whole; of rows alike in doc_id and text one stays, the same in every run; other rows that share a doc_id stand or fall together
from deduplication on; a null doc_id is never removed as a near duplicate or as contaminated; empty tables give an empty result;
columns of any name pass through, and the last stage's own get underscores after their names where documents has such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import decontaminate, mixing, near_dedup, quality, sharding
from riskframe.llm._shared import fresh, read_table, staged

SHARDS = 40


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in gone, columns in their order."""
    (name,) = fresh(docs.columns, "gone")
    ids = gone.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"] == F.col(name), "left_anti")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with one row, of the least hash, of those alike in doc_id and text.

    Only ids and hashes are grouped over all rows; whole rows move only where they are repeated, and are combined before they do.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    whole = [F.col(c) for c, kind in plain.dtypes if "map<" not in kind]
    keyed = plain.select(F.struct(*plain.columns).alias("row"), doc_id.alias("id"), F.xxhash64(text, text.isNull()).alias("hash"), F.xxhash64(*whole).alias("order"))
    keys = keyed.groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("k_id"), F.col("hash").alias("k_hash"))
    keys, same = staged(keys, "repeated"), F.expr("id <=> k_id and hash = k_hash")
    least = keyed.join(keys, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", "order").alias("row"))
    rows = keyed.join(keys, same, "left_anti").select("row").union(least.select("row"))
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, and of repeated rows one."""
    return without(without_repeats(docs), near_dedup.near_duplicates(docs).filter("not kept"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of any benchmark item."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, by repeating and leaving out documents."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its size, its shard and its slot there, as _size, _shard and _slot where no column has these names."""
    return sharding.shard_by_bytes(docs, shards=SHARDS)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each_group), ("decontaminate", uncontaminated), ("mix", mixed), ("shard", sharded)]

#: SQL can express neither the classifier nor the random draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
