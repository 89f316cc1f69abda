import re
import string

import pytest

from riskframe.llm import decontaminate as dc

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, width=13):
    out = {}
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, test in items:
            w = words(test)
            for at in range(max(1, len(w) - width + 1)) if w else ():
                window = w[at : at + width]
                for p in range(len(own) - len(window) + 1):
                    if own[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item))
        out[i] = (len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own))
    return out


@pytest.fixture(scope="module")
def items(texts):
    long = [t for t in texts if t and len(t.split()) > 40]
    return [(3, long[0]), (12, " ".join(long[1].split()[5:30])), (100, "One, two; THREE!"), (7, None), (8, "..."), (9, " ".join(long[2].split()[:13])), (10, long[0]), (11, "absent words here")]


def brute_near(docs, items, distance=8, most=4):
    """Items with a proximity match, for each document."""
    own = {i: words(t) for i, t in docs}
    postings = {}
    for i, t in docs:
        for w in words(t):
            postings[w] = postings.get(w, 0) + 1
    out = {i: set() for i in own}
    for item, test in items:
        posted = [(k, w) for k, w in enumerate(words(test)) if w in postings]
        if not posted:
            continue
        at, anchor = min(posted, key=lambda x: (postings[x[1]], x[0]))
        beside = {}
        for k, w in posted:
            if abs(k - at) <= distance // 2 and w != anchor:
                beside.setdefault(w, k)
        beside = sorted(beside, key=lambda w: (postings[w], beside[w]))[: most - 1]
        for i, ws in own.items():
            if beside and any(w == anchor and all(b in ws[max(0, p - distance) : p + distance + 1] for b in beside) for p, w in enumerate(ws)):
                out[i].add(str(item))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("chunk, places", [(400_000, 1 << 20), (20, 7)])
def test_against_brute_force(spark, docs, texts, items, monkeypatch, chunk, places):
    monkeypatch.setattr(dc, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 300)
    monkeypatch.setattr(dc, "PLACES", places)
    out = dc.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    rows = out.collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == brute(list(enumerate(texts)), items)
    # Postings count repeated rows.
    near = brute_near([(i, t) for i, t in enumerate(texts) for _ in range(3 if i == 3 else 1)], items)
    assert any(near.values()) and {r.doc_id: r.near for r in rows} == near


def test_windows_are_arrays():
    """A chunk of 100,000 words takes a few times 13 numbers a word, however many items it comes from."""
    items = dc.Items([(i, " ".join(f"w{i}x{k}" for k in range(500))) for i in range(200)], 13)
    assert items.windows.shape == (200 * 488, 13) and items.windows.nbytes + items.lengths.nbytes + items.first.nbytes + items.owners.nbytes < 13e6


def test_empty_sides(spark, docs, no_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(no_docs, bench).count() == 0
    assert dc.contamination(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "alpha"), (4, "beta alpha")], "doc_id long, text string")
    items = dc.Items([(5, "alpha beta")], 13)
    found = dc.search_proximity(dc.build_index(docs), items, distance=3)
    assert {r.doc_id for r in found.collect()} == {1, 4}
