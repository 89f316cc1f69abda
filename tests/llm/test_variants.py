import random
import zlib
from collections import Counter

import pytest

from riskframe.llm import variants


def near(a, b):
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, length=5, least=3, twice=2):
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= least}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v), default=None) for w, vs in beside.items()}
    form = {w: v if v and n[v] >= twice * n[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n}


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def spelt(rng, n):
    """Words of few letters, many of them near each other, some long, with Latin-1 letters."""
    out = {"a" * 5: 9, "a" * 6: 18, "a" * 7: 40, "b" * 400: 3, "b" * 401: 7, "ÿzebra": 5, "zebra": 5, "éclair": 4, "eclair": 8}
    while len(out) < n:
        word = "".join(rng.choice("aabcé") for _ in range(rng.randint(4, 9)))
        out[word] = rng.choice([1, 2, 3, 4, 6, 8, 8, 20, 60])
    return out


@pytest.mark.parametrize("size", [1 << 16, 40])
def test_against_all_pairs(spark, monkeypatch, size):
    """With size 40 the tries are numbered in many ranges, whose borders cut through shared prefixes."""
    monkeypatch.setattr(variants, "RANGE", size)
    counts = spelt(random.Random(4), 700)
    df = spark.createDataFrame([(w, k, "x") for w, k in counts.items()], "word string, n long, form string")
    assert result(variants.spelling_forms(df)) == brute(counts)


def test_other_limits_and_no_words(spark):
    counts = spelt(random.Random(9), 150)
    df = spark.createDataFrame(list(counts.items()), "w string, k long")
    assert result(variants.spelling_forms(df, 4, 1, 3, "w", "k")) == brute(counts, 4, 1, 3)
    assert variants.spelling_forms(df.filter("false"), word_col="w", n_col="k").collect() == []


def test_numbers_of_nodes_are_exact(spark, monkeypatch):
    """Equal prefixes have equal numbers and different ones different, whatever ranges they lie in."""
    monkeypatch.setattr(variants, "RANGE", 7)
    words = ["a", "aa", "aaa", *(f"aab{c}{d}" for c in "abcdefg" for d in "xyz"), "b", "ba", "bab", "zz"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(words)), "no long, word string")
    seen = {}
    for r in variants.trie_nodes(df, F.col("word")).collect():
        for i, node in enumerate(r.nodes):
            assert seen.setdefault(words[r.no][:i], node) == node
    assert len(set(seen.values())) == len(seen)


def test_chains_of_forms(spark):
    counts = {"stone": 1000, "stones": 400, "stoness": 100, "stonesss": 30, "stonessss": 10, "stonesssss": 4, "cloud": 5, "clouds": 5}
    out = result(variants.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out["stonesssss"] == ("stonessss", "stone", 4, 1, 10) and out["stone"][:2] == (None, "stone")
    assert out["cloud"] == (None, "cloud", 5, 1, None)


def test_counts(spark, docs, texts, no_docs, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    plain, slipped = Counter(), Counter()
    for i, text in rows:
        for w in variants.LETTERS.findall(fold(text or "")):
            plain[w] += 1
            h = zlib.crc32(f"{i}:{w}".encode())
            slipped[w if h % 7 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert "Ëtna" in plain and "stra" not in plain
    for held in (1 << 18, 3):
        monkeypatch.setattr(variants, "HELD", held)
        assert {r.word: r.n for r in variants.word_counts(docs).collect()} == plain
        assert {r.word: r.n for r in variants.word_counts(docs, slip=7).collect()} == slipped
    assert variants.word_counts(no_docs).collect() == []
    df = spark.createDataFrame([(None, "Öl öl× x-y")], "doc_id string, text string")
    assert {r.word: r.n for r in variants.word_counts(df, slip=1).collect()} == {"Öl": 1, "öl×": 1, "x": 1, "y": 1}
