"""Exact top-k inner products over norm-sorted vectors.

Vectors are sorted by descending length and stored. The longest ones, a bounded head, give the leading directions of an SVD,
which gather their energy, and a first k-th best score for each query. Tasks then go through the vectors from long to short: a
run is skipped for queries whose length times the run's greatest length cannot reach their k-th best score, other pairs are
dropped where the partial sum over the leading rotated dimensions plus the product of the remaining lengths (Cauchy-Schwarz)
cannot, and only the rest get their exact score. Bounds allow for rounding.

Queries go to the tasks in blocks of at most about ``NUMBERS`` components, ordered by the shortest length of a vector that can still be
among their best; a block's pass reads only vectors at least as long as its queries need, which are the first ones of the sorted
table, so later vectors are read by few passes or none. Each pass's best of each task are stored before the next block begins.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with zeros;
a null id is no query but a candidate, after all others on ties; rows that share an id are rows of their own, each a candidate of the others
and, if a query, with ranks of its own; ties go to the smaller id; scores are exact as long as they and all components fit a
long, others are rounded as doubles and held within 64 bits; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.llm._shared import known_columns, scratch_root, staged

#: Vectors of the head and queries of a block at most, and components of either.
HEAD, QUERIES, NUMBERS = 2048, 32_768, 1 << 22
#: Queries and vectors scored at a time.
TILE, RUN = 512, 2048
#: Rotated dimensions in the partial sum.
FIRST = 16
EXACT = 2.0**53
LIMIT = 2.0**63 - 1024
#: Stands for a null id in arrays of ids, and comes after all others.
NO_ID = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, v, norm): floor(scale * component) as doubles, with the squared length; row is fixed once the rows are stored."""
    rows = known_columns(df, id=id_col, x=vector_col).select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("x").isNotNull()).filter(fine)
    # floor() gives a long; components beyond its range are whole numbers already.
    v = F.transform("x", lambda c: F.when(F.abs(c) * scale < EXACT, F.floor(F.when(F.abs(c) * scale < EXACT, c * scale).otherwise(0.0)).cast("double")).otherwise(c * scale))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", v.alias("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of numbers, padded with zeros."""
    lengths, values = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def lists(column: pa.ChunkedArray) -> pa.ListArray:
    """A collected column of vectors in one piece."""
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks else pa.array([], column.type) if isinstance(whole, pa.ChunkedArray) else whole


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(axis=1))


def leading(head: np.ndarray) -> np.ndarray:
    """The leading directions of the head, of any dimension."""
    if not len(head) or not np.isfinite((head**2).sum()):
        return np.eye(head.shape[1], min(FIRST, head.shape[1]))
    return np.linalg.svd(head, full_matrices=False)[2][:FIRST].T


def turned(vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated components, and the length of what they leave."""
    first = vectors @ rotation
    return first, lengths_of(vectors - first @ rotation.T)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of each row of q with that of c, as 64-bit numbers. Doubles are exact where the lengths bound all sums below 2**53; beyond,
    64-bit sums, which wrap, are right wherever the result and all components fit."""
    rough = np.einsum("ij,ij->i", q, c)
    out = np.clip(np.nan_to_num(rough, nan=0.0), -LIMIT, LIMIT).astype(np.int64)
    large = np.flatnonzero(np.einsum("ij,ij->i", abs(q), abs(c)) >= EXACT)
    fits = large[(abs(q[large]).max(axis=1, initial=0) < LIMIT) & (abs(c[large]).max(axis=1, initial=0) < LIMIT) & (abs(rough[large]) < LIMIT)]
    for i in range(0, len(fits), RUN):
        at = fits[i : i + RUN]
        with np.errstate(over="ignore"):
            out[at] = (q[at].astype(np.int64) * c[at].astype(np.int64)).sum(axis=1)
    return out


class Queries:
    """A block of queries with the rotation and each query's k-th best score so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, rotation: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.least, self.rotation, self.k = rows, ids, vectors, least, rotation, k
        self.length = lengths_of(vectors)
        self.first, self.rest = turned(vectors, rotation)

    def offers(self, rows: np.ndarray, vectors: np.ndarray, least: np.ndarray, tile: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query in the tile, place in the run, score) of a run's pairs that may be among the k best."""
        length = lengths_of(vectors)
        slack = 1e-9 * (1 + self.length[tile] * length.max(initial=0))
        live = np.flatnonzero(self.length[tile] * length.max(initial=0) + slack >= least)
        if not len(live):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        first, rest = turned(vectors, self.rotation)
        bound = self.first[tile][live] @ first.T
        bound += np.outer(self.rest[tile][live], rest) + slack[live, None]
        query, place = np.nonzero(bound >= least[live, None])
        # Products of all that is left, then the exact score of those that may still do.
        need, at = np.unique(place, return_inverse=True)
        near = (self.vectors[tile][live] @ vectors[need].T)[query, at] + slack[live][query] >= least[live][query]
        query, place = live[query[near]], place[near]
        keep = rows[place] != self.rows[tile][query]
        query, place = query[keep], place[keep]
        scores = [exact(self.vectors[tile][query[i : i + RUN]], vectors[place[i : i + RUN]]) for i in range(0, len(query), RUN)]
        return query, place, np.concatenate(scores) if scores else np.empty(0, np.int64)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids, and the k-th score of queries that have k."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < k
    least = np.full(n, -np.inf)
    full = rank == k - 1
    least[query[full]] = scores[full]
    return query[keep], ids[keep], scores[keep], least


def _scan(block):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(*block.value)
        tiles = [slice(i, i + TILE) for i in range(0, len(q.ids), TILE)]
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in tiles]
        least = [q.least[t].copy() for t in tiles]
        for batch in batches:
            for i in range(0, batch.num_rows, RUN):
                part = batch.slice(i, RUN)
                rows, ids, vectors = part.column(0).to_numpy(), part.column(1).fill_null(NO_ID).to_numpy(), matrix(part.column(2), q.vectors.shape[1])
                for t, tile in enumerate(tiles):
                    query, place, scores = q.offers(rows, vectors, least[t], tile)
                    if len(query):
                        joined = [np.concatenate(x) for x in zip(held[t], (query, ids[place], scores))]
                        *held[t], kth = best(*joined, q.k, len(least[t]))
                        least[t] = np.maximum(least[t], kth)
        for t, tile in enumerate(tiles):
            query, ids, scores = held[t]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.rows[tile][query], pa.int64()), pa.array(q.ids[tile][query], pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
                ["query_row", "query_id", "vec_id", "score"],
            )

    return scan


def _seed(head_rows: np.ndarray, head: np.ndarray, k: int, dim: int):
    """The k-th best score of each query within the head, a lower bound of its true one but for rounding, and the shortest length it needs."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                rows, vectors = part.column(0).to_numpy(), matrix(part.column(2), dim)
                scores, length = vectors @ head.T, lengths_of(vectors)
                scores[rows[:, None] == head_rows[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(rows), -np.inf)
                least = least - 1e-9 * (1 + length * lengths_of(head).max(initial=0))
                needs = np.divide(least, length, out=np.zeros(len(rows)), where=(least > 0) & (length > 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least), pa.array(needs)], ["row", "id", "v", "least", "needs"])

    return seed


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query (a condition on ``id``) picks, the k other rows of highest inner product."""
    spark = df.sparkSession
    vectors = staged(whole_vectors(df, id_col, vector_col, scale), "vectors")
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    order = [F.desc("norm"), F.col("id"), F.col("row")]
    ordered = staged(vectors.repartitionByRange(*order).sortWithinPartitions(*order), "ordered")
    head = ordered.orderBy(*order).limit(max(1, min(HEAD, NUMBERS // dim))).select("row", "v").toArrow()
    head_rows, longest = head.column("row").to_numpy(), matrix(lists(head.column("v")), dim)
    rotation = leading(longest)
    queries = vectors.filter(is_query & F.col("id").isNotNull()).select("row", "id", "v")
    blocks = -(-queries.count() // max(1, min(QUERIES, NUMBERS // dim)))
    kinds, path = "query_row long, query_id long, vec_id long, score long", f"{scratch_root(spark)}/found"
    spark.createDataFrame([], kinds).write.parquet(path)
    if blocks:
        seeded = queries.mapInArrow(_seed(head_rows, longest, k, dim), "row long, id long, v array<double>, least double, needs double")
        queries = staged(staged(seeded, "seeded").repartitionByRange(blocks, F.desc("needs"), "row").withColumn("block", F.spark_partition_id()), "queries")
    for n in range(blocks):
        own = queries.filter(F.col("block") == n).drop("block").toArrow()
        if not own.num_rows:
            continue
        columns = [own.column(c).to_numpy() for c in ("row", "id", "least", "needs")]
        block = (columns[0], columns[1], matrix(lists(own.column("v")), dim), columns[2], rotation, k)
        sent = spark.sparkContext.broadcast(block)
        long = ordered.filter(F.col("norm") >= float(columns[3].min()) ** 2 * (1 - 1e-9))
        long.select("row", "id", "v").mapInArrow(_scan(sent), kinds).write.mode("append").parquet(path)
        sent.destroy()
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    out = spark.read.schema(kinds).parquet(path).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
