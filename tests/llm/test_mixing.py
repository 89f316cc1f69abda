import math
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while True:
        level = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if level[s] > most * sizes[s]}
        if not over:
            return {**out, **level}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over


@pytest.fixture(scope="module")
def drawn(docs):
    return mixing.mixed(docs).collect()


def test_targets_and_sizes(docs, texts, drawn):
    sizes = {}
    for r in drawn:
        assert r._mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r._mix_size
    want = targets(sizes)
    for r in drawn:
        assert (r._mix_source_size, r._mix_target) == (sizes[r.source], pytest.approx(want[r.source]))
        assert len(r._mix_draws) <= 2


def test_small_documents_come_near_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}") for i in range(3000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.first("_mix_target").alias("t"), F.sum(F.col("_mix_size") * F.size("_mix_draws")).alias("n")).collect():
        assert abs(r.n - r.t) <= 20


def test_draws_are_disjoint_blocks_and_quotas_exact(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 9), (3, 1)], "source_no long, quota long")
    rows = mixing.split_tree(quotas, 7, 1).collect()
    per_source, per_shard = {}, {}
    for r in rows:
        per_source[r.source_no] = per_source.get(r.source_no, 0) + r.quota
        per_shard[r.shard] = per_shard.get(r.shard, 0) + r.quota
    assert per_source == {1: 40, 2: 9, 3: 1} and sum(per_shard.values()) == 50 and max(per_shard.values()) - min(per_shard.values()) <= 2


def test_reruns_and_rows(docs, no_docs, drawn):
    again = sorted((r.doc_id, r._mix_draws) for r in mixing.mixed(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id, r._mix_draws) for r in drawn)
    made = mixing.mixture(docs)
    assert made.columns == docs.columns and made.count() == sum(len(r._mix_draws) for r in drawn)
    assert mixing.mixed(no_docs).count() == mixing.mixture(no_docs).count() == 0


def brute_taken(rows, seed=42, weights=(5, 2, 1), share=1.5, most=2.0):
    """{(doc_id, text): times drawn} by plain loops over whole lists: the same hashes, blocks and orders."""
    import struct

    import xxhash

    def spread(*of):
        h = xxhash.xxh64(struct.pack("<i", seed), 42).intdigest()
        for x in of:
            if x is not None:
                h = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<i" if x < 4096 and not isinstance(x, Long) else "<q", x), h).intdigest()
        return h

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    docs, sizes = [], {}
    for i, text, source in rows:
        h = signed(spread(Long(i), text))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        docs.append((i, text, source, n, h % 64, (h >> 20) % 4096))
        sizes[source] = sizes.get(source, 0) + n
    want, drawn = targets(sizes, weights, share, most), {}
    for source, size in sizes.items():
        own = [d for d in docs if d[2] == source]
        passes = int(want[source] // size) if size else 0
        rest, whole, part = want[source] - passes * size, set(), set()
        words = lambda at, few: {b: sum(d[3] for d in few if d[at] == b) for b in {d[at] for d in few}}

        def fill(parts, left):
            got = set()
            for b in sorted(parts, key=lambda b: (signed(spread(b)), b)):
                if 0 < parts[b] <= left:
                    got.add(b)
                    left -= parts[b]
            return got, left

        blocks = words(4, own)
        whole, rest = fill(blocks, rest)
        others = [(n, b) for b, n in blocks.items() if n > 0 and b not in whole]
        cut = min(others)[1] if others else None
        if cut is not None and rest > 0:
            subs = words(5, [d for d in own if d[4] == cut])
            part, rest = fill(subs, rest)
            over = [(n, b) for b, n in subs.items() if 0 < n < 2 * rest and b not in part]
            part |= {min(over)[1]} if over else set()
        for d in own:
            drawn[d[:2]] = passes + (d[4] in whole or d[4] == cut and d[5] in part)
    return drawn


class Long(int):
    pass


@pytest.mark.parametrize("n", [40, 700])
def test_draws_against_plain_loops(spark, n):
    rows = [(i, None if i % 31 == 0 else "w " * (1 + i * i % 23), None if i % 5 == 4 else f"s{i % 9 // 2}") for i in range(n)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.text): len(r._mix_draws) for r in out} == brute_taken(rows)


def test_clashing_mix_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, 8, 7, 6)], "doc_id long, text string, source string, _mix_size long, _MIX_draws long, words long, draw long")
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "_mix_size_", "_mix_source_size", "_mix_target", "_mix_draws_"] and out.first()._mix_size_ == 2
    assert mixing.mixture(df).columns == df.columns


def test_each_run_is_a_task(spark, monkeypatch):
    """A shard's order is cut into runs of hashes, and a partition holds one."""
    monkeypatch.setattr(mixing, "TASK_WORDS", 200)
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    made = mixing.mixture(df, shards=4)
    n = made.count()
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert made.rdd.getNumPartitions() == 4 * math.ceil(n * 10 / 4 / 200) and sizes.sum() == n and sizes.max() < 4 * n / made.rdd.getNumPartitions()


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r._mix_size, r._mix_target) for r in mixing.mixed(df).collect()} == {(0, 0.0)}
