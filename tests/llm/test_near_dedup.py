import re
import string

import numpy as np
import pytest

from riskframe.llm import near_dedup
from riskframe.llm.shingles import PIECE, shingle_set

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=4):
    """component of each id, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets)}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("small", [24, 2])
def test_against_all_pairs(spark, docs, texts, monkeypatch, small):
    """With small = 2 nearly all buckets take the way of large ones."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 3 if small == 2 else 512)
    out = near_dedup.near_duplicates(docs, width=4)
    assert out.count() == docs.count()
    assert result(out) == brute(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_open_nodes_of_one_template(spark, monkeypatch):
    """Texts that share half their words, in pairs that are linked: all in one large bucket, whose hub is linked to one of them."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "band_values", lambda hashes: np.arange(near_dedup.BANDS, dtype=np.int64))
    template = " ".join(f"t{i}" for i in range(40))
    own = lambda k, n: " ".join(f"o{k}x{i}" for i in range(n))
    texts = [f"{template} {own(k, 40)}{end}" for k in range(12) for end in ("", " end")] + [own(99, 30), "t1 t2 t3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width in (4, 5):
        out = near_dedup.near_duplicates(df, width=width)
        assert result(out) == brute(list(enumerate(texts)), width)


def test_default_is_five_words(spark):
    """40 words of which one inner word differs: 33 of 41 four-word shingles are shared, but 31 of 41 five-word ones."""
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "new", *words[21:]]))], "doc_id long, text string")
    assert [near_dedup.near_duplicates(df, **kw).filter("kept").count() for kw in ({}, {"width": 4})] == [2, 1]


def test_empty_table(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text + " "), (None, None), (9, "p q r s t")], "doc_id long, text string")
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(df, width=4).collect()}
    assert rows[(5, 5)] == rows[(None, 5)] == 5 and rows[(9, 2)] == 9 and rows[(None, 0)] is None


def test_long_texts_are_hashed_in_pieces():
    words = [str(i % 70_001).encode() for i in range(2 * PIECE + 5)]
    whole = shingle_set(b" ".join(words), 4)
    want = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
    assert len(whole) == len(want) and (np.diff(whole.astype(object)) > 0).all()


def test_contraction(spark):
    from riskframe.llm.components import components

    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (21, 20), (30, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    groups = {}
    for r in components(df).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6, 7, 8, 9], [20, 21]]
