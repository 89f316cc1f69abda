import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle import DATA, needs_data

from riskframe.llm import queries, runs


def brute(words, min_length=24, exponent=3):
    """(start, length, period) of all runs, by looking at every period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def words_with_runs(rng):
    letters = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 24, 60, 200]))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(letters + 3) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = unit * rng.randint(2, 12) + unit[: rng.randrange(len(unit))]
        if rng.random() < 0.4 and len(words) < 200:
            words = words * rng.randint(2, 4)
    return words


def test_random_words_against_every_period():
    rng = random.Random(5)
    for _ in range(150):
        docs = [words_with_runs(rng) for _ in range(rng.randint(1, 6))]
        docs += docs[:1]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = [(a, b - a, q) for a, b, q in zip(*(x.tolist() for x in runs.runs_of(ids, 60, doc, 24, 3)))]
        heads = np.cumsum([0, *map(len, docs)]).tolist()
        assert got == [(a + h, n, q) for h, d in zip(heads, docs) for a, n, q in brute(d)]


@pytest.mark.parametrize("exponent, min_length", [(4, 24), (3, 60)])
def test_other_limits(exponent, min_length):
    rng = random.Random(8)
    for _ in range(40):
        ids = words_with_runs(rng) or [0]
        got = runs.runs_of(np.array(ids), 60, np.zeros(len(ids), int), min_length, exponent)
        assert [(a, b - a, q) for a, b, q in zip(*(x.tolist() for x in got))] == brute(ids, min_length, exponent)
    with pytest.raises(ValueError):
        runs.periodic_runs(None, min_length=8)


def test_words_that_trick_hashes():
    """The Thue-Morse sequence has no run, but its halves have equal polynomial hashes modulo powers of two."""
    odd = np.array([i.bit_count() & 1 for i in range(1 << 13)])
    assert len(runs.runs_of(odd, 2, np.zeros(len(odd), int), 24, 3)[0]) == 0
    assert [x.tolist() for x in runs.runs_of(np.tile(odd[:64], 5), 2, np.zeros(320, int), 24, 3)] == [[0], [320], [64]]


def test_grammar_derives_the_text():
    rng = random.Random(2)
    docs = [words_with_runs(rng) for _ in range(8)]
    ids = np.array([x for d in docs for x in d])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    grammar, tops, at = runs.compress(ids, 60, doc)
    left, right = np.concatenate(grammar.left), np.concatenate(grammar.right)

    def derived(s):
        return [s] if s < 60 else derived(left[s - 60]) + derived(right[s - 60])

    assert [derived(s) for s in tops] == [d for d in docs if d] and len(at) == len(tops)
    repeated = runs.compress(np.zeros(64, np.int64), 1, np.zeros(64, int))[0]
    assert repeated.size == 7  # one id and six doublings


def test_texts(spark, docs, texts, no_docs, monkeypatch):
    loop = " ".join("the river stone of the cloud".split() * 6)
    rows = [(str(i), t) for i, t in enumerate([*texts, loop, "Go " * 30, f"x {loop}\n{loop} y"])] + [(None, loop), (None, loop)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(2)
    for chunk in (1 << 18, 50):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        out = runs.periodic_runs(df, id_col="name", text_col="body").collect()
        assert len(out) == len(rows)
        want = {}
        for name, text in rows:
            words = (text or "").split()
            want[name] = (len(words), brute(words), " ".join(collapsed(words, brute(words))))
        assert {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out} == want
        assert all((r.best is None) == (not r.runs) for r in out)
    assert runs.periodic_runs(docs).count() == docs.count() and runs.periodic_runs(no_docs).collect() == []


def test_best_run():
    assert runs.best_run([(9, 30, 10), (5, 60, 20), (0, 31, 11), (5, 27, 9)]) == (5, 27, 9)
    assert runs.best_run([(0, 10**17 * 3, 10**17), (1, 10**17 * 3 + 1, 10**17)]) == (1, 10**17 * 3 + 1, 10**17)


@needs_data
def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for r in queries.op12_runs(spark, str(DATA)).collect():
        words = docs[r.doc_id].split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            words = words[:a] + [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
        found = brute(words)
        best = runs.best_run(found) if found else (None, None, None)
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(found), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in found))
        assert r.collapsed_sha256 == digest(" ".join(collapsed(words, found)))
        some += len(found)
    assert some
