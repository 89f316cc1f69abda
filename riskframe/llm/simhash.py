"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has the bits that are set in over half of the hashes of its word shingles. Fingerprints that differ in
``RADIUS`` bits or fewer are linked, and documents of linked fingerprints, directly or through others, are one component.

Distinct fingerprints are dealt to shards by trees of vantage points. At a node those within a distance of the vantage
point go inside and the others outside; by the triangle inequality two linked fingerprints on different sides lie at most
``RADIUS`` apart in their distance, so those outside that are as near to the border go inside too, and each linked pair
meets in some leaf. A tree is fitted to a sample of the fingerprints that it will split, about ``SAMPLE`` of them, which only
decides where the borders lie: every fingerprint goes down it. Leaves of more than ``SHARD`` members are split in the
next round by trees of their own. Within a shard the same cuts go on in memory, down to ``LEAF`` members, which are compared
directly. Where cuts no longer help (members crowded in a small ball), all pairs of blocks of the shard are compared instead,
so that nothing is capped. Each task ties the members of each linked group it finds to one of them, and components are found by contracting edges.

A tree reaches its shard's members as the first row of a sorted stream, so no task holds more than a batch of members beside one tree.

Defined results: null texts and texts without words have fingerprint zero and are linked like any other; repeated rows share a
fingerprint and a component; a null id takes part but is never a component's id unless all are null; ids may be of any type that can
be ordered; texts of fewer words than the width are one shingle; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskframe.llm._shared import known_columns, staged
from riskframe.llm.components import components
from riskframe.llm.shingles import LOWER, PIECE, mix, utf8

SEED = 42
RADIUS = 2
#: Members of a shard, of a leaf within it, and of the sample that a tree is fitted to.
SHARD, LEAF, SAMPLE = 8192, 256, 8192
#: Members of a shard that go down its tree in one task.
STREAM = 1 << 18
#: Levels of a tree, sampled members that a cut is chosen by, vantage points tried for it, and the share of pairs that a cut must not exceed.
DEPTH, LEAST, TRIED, HELPS = 10, 32, 8, 0.9


def fingerprint(text: bytes, width: int) -> int:
    """The 64-bit fingerprint of UTF-8 text; A-Z lower-cased, words parted by ASCII white space."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    size, total, ones = min(width, len(words)), 0, np.zeros(64, np.int64)
    for at in range(0, len(words) - size + 1, PIECE):
        piece = words[at : at + PIECE + size - 1]
        line = b" ".join(piece)
        ends = np.cumsum([len(w) + 1 for w in piece])
        starts = (ends - [len(w) + 1 for w in piece])[: len(piece) - size + 1].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends - 1)[size - 1 :].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(utf8(t), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return fingerprints


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_cut(points: np.ndarray) -> tuple[np.uint64, int, float]:
    """(vantage point, distance, share of pairs left): of some of the points the one, with its distance, that leaves the fewest pairs to compare."""
    best = (points[0], 64, 2.0)
    for vantage in points[:: max(1, len(points) // TRIED)]:
        within = np.cumsum(np.bincount(distances(points, vantage), minlength=65 + RADIUS))
        inside, outside = within[RADIUS:65 + RADIUS] / len(points), 1 - within[:65] / len(points)
        left = inside**2 + outside**2
        at = int(left.argmin())
        if left[at] < best[2]:
            best = (vantage, at, float(left[at]))
    return best


def halves(points: np.ndarray, vantage, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where points go inside, and where outside: those near the border go both ways, if they lie outside."""
    d = distances(points, vantage)
    return np.flatnonzero(d <= radius + RADIUS), np.flatnonzero(d > radius)


def grow(sample: np.ndarray, members: float, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """A tree as (vantage point, distance, place of the outside) in preorder, a leaf being (0, -1, 0), for so many members as the sample stands for."""
    if members > SHARD / 2 and depth and len(sample) >= LEAST:
        vantage, radius, left = best_cut(sample)
        if left < HELPS:
            inner, outer = (sample[side] for side in halves(sample, vantage, radius))
            if len(inner) and len(outer):
                a, b = (grow(part, members * len(part) / len(sample), depth - 1) for part in (inner, outer))
                return [(int(vantage), radius, len(a) + 1), *a, *b]
    return [(0, -1, 0)]


def leaves(tree: list[tuple[int, int, int]], points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of the points that go there)."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        vantage, radius, outside = tree[node]
        if radius < 0:
            yield node, at
        elif len(at):
            inner, outer = halves(points[at], np.uint64(vantage), radius)
            todo += [(node + 1, at[inner]), (node + outside, at[outer])]


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tree of a shard from its sampled members; none where no cut helps."""
    sample = np.sort(pdf.fp.to_numpy().view(np.uint64))
    tree = grow(sample, float(pdf.n.iloc[0]))
    packed = np.array(tree, [("v", "<u8"), ("r", "<i4"), ("o", "<i4")]).tobytes()
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "tree": [packed if len(tree) > 1 else None]})


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, fp) after one round, of (shard, fp, tree) rows in which a shard's tree comes before its members."""
    shard, tree = None, None
    for batch in batches:
        shards, points, trees = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
        first = np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False))
        for a, b in zip([0, *first], [*first, len(points)]):
            if b > a:
                if trees[a].is_valid:
                    shard, tree = shards[a], np.frombuffer(trees[a].as_buffer(), [("v", "<u8"), ("r", "<i4"), ("o", "<i4")]).tolist()
                    a += 1
                for leaf, at in leaves(tree, points[a:b]):
                    name = mix(np.array([shard], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(leaf + 1)).view(np.int64)[0]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(int(name), pa.int64()), len(at)), pa.array(points[a:b][at].view(np.int64))], ["shard", "fp"])


def shards_of(points: DataFrame) -> DataFrame:
    """(shard, n, fp) of distinct fingerprints (fp), n being the members of the shard: linked ones share a shard.

    Each round runs jobs while the plan is built, one round for every thousandfold of the fingerprints or so.
    """
    done, members = None, staged(points.select(F.lit(0).cast("long").alias("shard"), "fp"), "members")
    while True:
        sizes = staged(members.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        members = members.join(sizes, "shard").select("shard", "n", "fp")
        sample = members.filter(F.col("n") > SHARD).filter(F.pmod(F.xxhash64("fp"), "n") < SAMPLE)
        trees = staged(sample.groupBy("shard").applyInPandas(_grown, "shard long, tree binary").filter("tree is not null"), "trees")
        ready = members.join(trees.select("shard"), "shard", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if not trees.limit(1).count():
            return done
        tasks = F.ceil(F.col("n") / STREAM)
        rows = members.join(trees.select("shard"), "shard", "left_semi").select("shard", F.pmod(F.xxhash64("fp", F.lit(1)), tasks).alias("task"), "fp", F.lit(None).cast("binary").alias("tree"))
        tops = trees.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"), F.lit(0).cast("long").alias("fp"), "tree")
        stream = rows.unionByName(tops).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("tree").isNull())
        members = staged(stream.select("shard", "fp", "tree").mapInArrow(_dealt, "shard long, fp long"), "members")


def close_pairs(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the linked pairs of distinct points, some of them more than once."""
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        here = points[at]
        if len(at) > LEAF:
            vantage, radius, left = best_cut(here[:: max(1, len(here) // 1024)])
            inner, outer = halves(here, vantage, radius)
            if left < HELPS and len(inner) < len(at) and len(outer) < len(at):
                todo += [at[inner], at[outer]]
                continue
        for i in range(0, len(at), LEAF):
            a, b = np.nonzero(distances(here[i:, None], here[None, i : i + LEAF]) <= RADIUS)
            yield at[i:][a], at[i : i + LEAF][b]


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges from the linked members of a shard, or of two of its blocks, to one of each group."""
    points = np.unique(pdf.fp.to_numpy()).view(np.uint64)
    root = np.arange(len(points))
    for a, b in close_pairs(points):
        a, b = root[a], root[b]
        while (apart := a != b).any():
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(root, b, a)
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    tied = np.flatnonzero(root != np.arange(len(points)))
    return pd.DataFrame({"a": points[root[tied]].view(np.int64), "b": points[tied].view(np.int64)})


def links_of(points: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) by which all that are linked hang together."""
    blocks = F.ceil(F.col("n") * 2 / SHARD)
    blocks = F.when(F.col("n") <= SHARD, F.lit(1)).otherwise(blocks).cast("long")
    rows = shards_of(points).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(2)), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("shard", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return staged(rows.groupBy("shard", "i", "j").applyInPandas(_forest, "a long, b long"), "links")


def near_fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of df; fingerprint as a signed 64-bit number."""
    docs = known_columns(df, doc_id=id_col, text=text_col)
    made = docs.mapInArrow(_fingerprints(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")
    made = staged(made, "fingerprints")
    points = staged(made.groupBy("fp").agg(F.min("doc_id").alias("own_id")), "points")
    found = components(links_of(points.select("fp")))
    labelled = staged(points.join(found, F.col("fp") == F.col("node"), "left").select("fp", "own_id", "label"), "labelled")
    ids = staged(labelled.filter("label is not null").groupBy("label").agg(F.min("own_id").alias("component_id")), "ids")
    per_point = staged(labelled.join(ids, "label", "left").select("fp", F.coalesce("component_id", "own_id").alias("component_id")), "per_point")
    return made.join(per_point, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
