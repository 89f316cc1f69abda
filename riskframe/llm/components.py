"""Connected components by contraction, with joins and grouping alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.llm._shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b) edges, by contraction: nodes go to their smallest neighbour, if that is smaller,
    twice over; edges go along, and those within a node are dropped, until none is left.

    Nodes are hashes, so runs of ever smaller neighbours are short.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while edges.limit(1).count():
        near = edges.select(F.inline(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))))
        step = staged(near.groupBy("at").agg(F.min("to").alias("to")).select("at", F.least("at", "to").alias("to")), "step")
        on = step.select(F.col("at").alias("on"), F.col("to").alias("further"))
        for _ in range(2):
            step = step.join(on, F.col("to") == F.col("on")).select("at", F.col("further").alias("to"))
        step = staged(step, "step")
        ends = {c: step.select(F.col("at").alias(f"{c}_at"), F.col("to").alias(f"{c}_to")) for c in ("a", "b", "label")}
        found = found.join(ends["label"], F.col("label") == F.col("label_at"), "left")
        found = staged(found.select("node", F.coalesce("label_to", "label").alias("label")), "labels")
        moved = edges.join(ends["a"], F.col("a") == F.col("a_at")).join(ends["b"], F.col("b") == F.col("b_at"))
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = staged(moved.filter("a < b").distinct(), "edges")
    return found


def apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Of (bucket, node) rows those of buckets whose nodes have several labels of found, as (bucket, node, label, opened).

    A node is opened where its label isn't the bucket's most frequent one, so that of two nodes with different labels one is.
    Counts and tops are stored before rows join them, so that a bucket that holds many rows can be dealt to several tasks.
    """
    rows = staged(members.join(found, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    several = staged(rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket"), "several")
    rows = rows.join(several, "bucket")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = staged(sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top")).select("bucket", F.col("top.label").alias("top")), "top")
    return rows.join(top, "bucket").select("bucket", "node", "label", (F.col("label") != F.col("top")).alias("opened"))
