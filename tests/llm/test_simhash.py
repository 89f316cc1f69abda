import re
import string

import numpy as np
import xxhash
from oracle import DATA, needs_data

from riskframe.llm import queries, simhash

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    spans = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """component of each (id, fingerprint), by comparing all pairs."""
    points = sorted({f for _, f in rows})
    up = {f: f for f in points}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(points):
        for y in points[:i]:
            if (x ^ y).bit_count() <= 2:
                up[top(x)] = top(y)
    least = {}
    for i, f in rows:
        least[top(f)] = min(i, least.get(top(f), i))
    return {i: least[top(f)] for i, f in rows}


def scattered(rng, n):
    """Fingerprints in crowds that change one bit at a time, and others."""
    out = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(1, n):
        if rng.random() < 0.6:
            out[i] = out[rng.integers(0, i)]
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                out[i] ^= np.uint64(1) << np.uint64(k)
    return np.unique(out)


def test_fingerprints(texts):
    for text in [*texts[:40], *texts[-12:], "A b", "a B c", "über  Öl\x0b\x1c x"]:
        assert simhash.fingerprint((text or "").encode(), 3) == np.uint64(brute_fingerprint(text)).view(np.int64)


def test_long_texts_by_pieces(texts, monkeypatch):
    whole = [simhash.fingerprint((t or "").encode(), 3) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert [simhash.fingerprint((t or "").encode(), 3) for t in texts] == whole


def test_against_all_pairs(spark, docs, texts):
    found = simhash.near_fingerprints(docs).collect()
    assert len(found) == docs.count()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)])
    assert {r.doc_id: r.component_id for r in found} == want
    empty = {r.component_id for r in found if not (texts[r.doc_id] or "").split()}
    assert len(empty) == 1


def test_trees_of_several_rounds(spark, monkeypatch):
    """Small shards, samples and trees, so that shards are split anew, and crowded ones compared in blocks."""
    for name, value in dict(SHARD=100, LEAF=8, SAMPLE=100, STREAM=100, DEPTH=3, LEAST=4).items():
        monkeypatch.setattr(simhash, name, value)
    points = scattered(np.random.default_rng(3), 1200)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    from riskframe.llm.components import components

    labels = {r.node: r.label for r in components(simhash.links_of(df)).collect()}
    want = brute_components([(int(x), int(x)) for x in points])
    groups = {}
    for x in points:
        groups.setdefault(labels.get(int(x.view(np.int64)), int(x)), set()).add(want[int(x)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_a_crowd_that_no_cut_parts(spark, monkeypatch):
    """Fingerprints of two bits each: blocks of the shard are compared."""
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "LEAF", 16)
    points = [1 << i | 1 << j for i in range(40) for j in range(i)]
    from riskframe.llm.components import components

    found = components(simhash.links_of(spark.createDataFrame([(x,) for x in points], "fp long"))).collect()
    assert len(found) == len(points) and len({r.label for r in found}) == 1


def test_ids_of_any_type_and_nulls(spark, no_docs):
    rows = [("b", "one two three four"), ("a", "ONE two\tthree four"), (None, "one two three four"), (None, None)]
    df = spark.createDataFrame(rows, "name string, body string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_fingerprints(df, id_col="name", text_col="body").collect()}
    assert found == {("b", "a"), ("a", "a"), (None, "a"), (None, None)}
    assert simhash.near_fingerprints(no_docs).collect() == []


@needs_data
def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(list(prints.items()))
    rows = queries.op11_simhash(spark, str(DATA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}
