"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the smallest and the largest, so that half as many
hash evaluations fill the bands. Texts with equal shingle sets are one node. Nodes that share a band are compared on
their full sets:

* in a bucket of at most ``SMALL`` nodes, every pair;
* in a larger one, every node with the bucket's first node. Where that leaves a large bucket's nodes in several components,
  the nodes outside its most frequent one are open. A link of an open node to another node shows in its rarest shingles: of two
  sets that are linked, each has a common shingle among its ``n - ceil(0.8 n) + 1`` rarest. So only nodes that share such a
  shingle with an open one go on, in families that hang together by them, and open nodes are compared with their family block
  against block, as products of 0/1 matrices over shared shingles. Nothing is capped; pages that share a template but
  little else have no rare shingle in common and drop out, and real families cost the product of the two counts.

Links are confirmed on full sets, and components are found by contracting edges. Aggregates of buckets are stored before rows
join them, so that a bucket that holds many rows can be dealt to several tasks.

40 bands of 6 values miss a link of similarity 0.8 with probability (1 - 0.8**6)**40, about 5e-6.

Defined results: null texts and texts without words have an empty set and are linked with nothing, not even each other;
repeated rows share a node and a component; a null id takes part but is never a component's id unless all are null; an
empty table gives an empty table; columns other than id and text play no part; ids that aren't whole numbers raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from riskframe.llm._shared import known_columns, numbered, staged
from riskframe.llm.components import apart, components
from riskframe.llm.shingles import mix, shingle_set, utf8

BANDS, ROWS = 40, 6
SMALL, BLOCK = 24, 512
#: Links need 100 * shared >= PERCENT * union.
PERCENT = 80
#: Stands for a null id.
NO_ID = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(7))
_PERMUTATIONS = BANDS * ROWS // 2
_FACTOR = (_rng.integers(1, 1 << 31, _PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _rng.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint32)[:, None]
_WEIGHT = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the hashes under each permutation of 32-bit numbers."""
    low = np.full(_PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(_PERMUTATIONS, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        y = _FACTOR * x[None, i : i + 2048] + _SHIFT
        y ^= y >> np.uint32(16)
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.stack((low, high), axis=1).ravel()


def band_values(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band; buckets of different bands differ."""
    bands = mix(signature(hashes).astype(np.uint64).reshape(BANDS, ROWS)) * _WEIGHT
    return mix(mix(bands.sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def node_key(hashes: np.ndarray) -> int:
    """A 64-bit hash of the set; different sets share one with probability 2**-64."""
    total = mix(mix(hashes).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(hashes)))
    return int(total.view(np.int64)[0])


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, bands = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_set(utf8(text), width)
                ids.append(i)
                sizes.append(len(found))
                keys.append(node_key(found) if len(found) else None)
                bands.append(band_values(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "bands"],
            )

    return sketch


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingle_set(utf8(t), width) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([node_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "set"])

    return sets


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set of a, set of b) rows the (a, b) that are linked."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            keep.append(linked(shared(x, y), len(x), len(y)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(common, n, m):
    return 100 * common >= PERCENT * (n + m - common)


def _family_links(pdf):
    """Links between the open nodes of one block and all nodes of another, of one family."""
    import pandas as pd

    opened, every = pdf[pdf.side == 0], pdf[pdf.side == 1]
    pairs = []
    if len(opened) and len(every):
        sides = [[np.frombuffer(x, np.int64) for x in side.set] for side in (opened, every)]
        sizes = [np.array([len(x) for x in side]) for side in sides]
        columns = np.intersect1d(*[np.unique(np.concatenate(side)) for side in sides])
        common = np.zeros((len(opened), len(every)), np.int64)
        for at in range(0, len(columns), 8192):
            part = columns[at : at + 8192]
            grids = []
            for side in sides:
                grid = np.zeros((len(side), len(part)), np.float32)
                for row, x in zip(grid, side):
                    row[np.searchsorted(part, x[np.isin(x, part, assume_unique=True)])] = 1
                grids.append(grid)
            common += (grids[0] @ grids[1].T).astype(np.int64)
        a, b = np.nonzero(linked(common, sizes[0][:, None], sizes[1][None, :]))
        left, right = opened.node.to_numpy()[a], every.node.to_numpy()[b]
        pairs = [(x, y) for x, y in zip(left, right) if x != y]
    return pd.DataFrame(pairs, columns=["a", "b"])


def near_duplicates(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of df."""
    docs = known_columns(numbered(df, id_col), doc_id=id_col, text=text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = staged(docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, node long, bands array<long>"), "sketches")

    # Buckets of two nodes or more, a row for each of their nodes.
    own = sketches.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).filter("node is not null")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"))
    in_band = nodes.select("node", F.explode("bands").alias("bucket"))
    counts = staged(in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1"), "counts")
    member = staged(in_band.join(counts, "bucket"), "buckets")
    small = member.filter(f"n <= {SMALL}").select("bucket", F.col("node").alias("a"))
    close = small.join(small.withColumnRenamed("a", "b"), "bucket").filter("a < b").select("a", "b")
    star = member.filter(f"n > {SMALL} and node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = staged(close.union(star).distinct(), "pairs")

    # Full sets of the nodes in question, from one text of each.
    wanted = staged(own.groupBy("node").agg(F.min("doc_id").alias("first")).join(member.select("node").distinct(), "node"), "wanted")
    texts = docs.withColumn("first", F.coalesce("doc_id", F.lit(NO_ID))).join(wanted.hint("merge"), "first", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "node long, set binary").join(wanted, "node", "left_semi")
    sets = staged(sets.dropDuplicates(["node"]), "sets")

    links = staged(confirmed(pairs, sets), "links")
    found = components(links)
    more = family_links(member.filter(f"n > {SMALL}").select("bucket", "node"), found, sets)
    if more is not None:
        found = components(links.union(more))
    alone = sketches.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    labelled = staged(alone.join(found, "node", "left"), "labelled")
    ids = staged(labelled.filter("label is not null").groupBy("label").agg(F.min("own_id").alias("component_id")), "ids")
    per_node = labelled.join(ids, "label", "left").select("node", F.coalesce("component_id", "own_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "node").join(per_node, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are linked on their full sets."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, shingle) rows of (node, set) rows."""
    for batch in batches:
        for node, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.frombuffer(x.as_buffer(), np.int64)
            for i in range(0, len(found), 1 << 16):
                part = pa.array(found[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(node, pa.int64()), len(part)), pa.repeat(pa.scalar(len(found), pa.int64()), len(part)), part], ["node", "n", "shingle"])


def families(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, opened, family) of the (node, opened) rows that share one of their rarest shingles with an open node."""
    each = staged(nodes.join(sets, "node").select("node", "set").mapInArrow(_shingles, "node long, n long, shingle long"), "shingles")
    often = staged(each.groupBy("shingle").agg(F.count("*").alias("having")).filter("having > 1"), "often")
    ranked = each.join(often, "shingle", "left").withColumn("at", F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("having", F.lit(1)), "shingle")))
    # Shingles that only one node has make no link, but count among the rarest.
    rare = ranked.filter(f"having is not null and at <= n - ceil(n * {PERCENT} / 100.0) + 1").select("node", "shingle")
    rare = staged(rare.join(nodes, "node"), "rare")
    live = rare.groupBy("shingle").agg(F.count("*").alias("having"), F.max("opened").alias("opened"), F.min("node").alias("hub")).filter("having > 1 and opened")
    joined = rare.join(staged(live.select("shingle", "hub"), "live"), "shingle").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return nodes.join(components(joined).withColumnRenamed("label", "family"), "node")


def family_links(large: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that comparing with bucket hubs alone cannot show, in large buckets (bucket, node) whose nodes are in several components."""
    nodes = staged(apart(large, found).groupBy("node").agg(F.max("opened").alias("opened")), "apart")
    if not nodes.limit(1).count():
        return None
    nodes = staged(families(nodes, sets), "families")
    total = staged(nodes.groupBy("family").agg(F.count("*").alias("every"), F.sum(F.col("opened").cast("int")).alias("open")), "total")
    nodes = nodes.join(total, "family").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("every") / BLOCK)).cast("int"))
    nodes = nodes.withColumn("open_salt", F.pmod(F.xxhash64(F.lit("open"), "node"), F.ceil(F.col("open") / BLOCK)).cast("int"))
    rows = nodes.join(sets, "node")
    blocks = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int"))
    mine = rows.filter("opened").select("family", F.lit(0).alias("side"), "node", "set", F.col("open_salt").alias("i"), F.explode(blocks("every")).alias("j"))
    theirs = rows.select("family", F.lit(1).alias("side"), "node", "set", F.explode(blocks("open")).alias("i"), F.col("salt").alias("j"))
    made = mine.unionByName(theirs).groupBy("family", "i", "j").applyInPandas(_family_links, "a long, b long")
    return staged(made, "family_links")
