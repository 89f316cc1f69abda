import math
import random
import re
from collections import Counter

import pytest

from riskframe.operators import gazetteer
from riskframe.plans import semantic

KIND = "sample_id string, question string, context string, answer string"


def terms(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_cosine(a, b, weight):
    a, b = ({t: n * weight(t) for t, n in Counter(terms(x)).items()} for x in (a, b))
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(t, 0) for t, x in a.items()) / (length(a) * length(b)) if length(a) * length(b) else 0.0


def test_term_counts_matter(spark):
    """Five and two words of equal weight: not the same direction."""
    train = spark.createDataFrame([("1", "q", "x", "y")], KIND)
    df = spark.createDataFrame([("s", "", "a a a a b", "a b")], KIND)
    found = semantic.tfidf_cosines(semantic.fit_tfidf(train), df).first()
    assert found.cosine_ctx_ans == pytest.approx(5 / math.sqrt(17 * 2), abs=1e-6) and found.cosine_q_ans == 0


def test_cosines_against_plain_code(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("the of stone Über 7 river cloud x_y".split()) for _ in range(rng.choice([0, 1, 4, 30])))
    rows = [(str(i), text(), text(), text()) for i in range(60)] + [("n", None, None, None), ("b", "stone", " \t", "stone")]
    train = rows[:30]
    texts = [set(terms(x)) for r in train for x in r[2:]]
    weight = lambda t: math.log((60 + 1) / (sum(t in x for x in texts) + 1))
    weights = semantic.fit_tfidf(spark.createDataFrame(train, KIND))
    found = {r.sample_id: r for r in semantic.tfidf_cosines(weights, spark.createDataFrame(rows, KIND)).collect()}
    assert len(found) == len(rows)
    for name, q, c, a in rows:
        blank = not (c or "").strip()
        assert found[name].cosine_q_ans == pytest.approx(plain_cosine(q, a, weight), abs=2e-6)
        assert found[name].cosine_ctx_ans == pytest.approx(0 if blank else plain_cosine(c, a, weight), abs=2e-6)
    assert found["b"].cosine_q_ans == 1 and semantic.tfidf_cosines(weights, spark.createDataFrame([], KIND)).count() == 0


def brute_mentions(text, names):
    """Longest phrase at each place from the left; places are tokens."""
    table = {}
    for name in names:
        ts = tuple(terms(name))
        if ts:
            table[ts] = min(name, table.get(ts, name))
    ts, out, at = terms(text), [], 0
    while at < len(ts):
        n = max((len(p) for p in table if tuple(ts[at : at + len(p)]) == p), default=0)
        if n:
            out.append((at, n, table[tuple(ts[at : at + n])]))
        at += n or 1
    return out


def test_mentions_against_plain_code(spark):
    rng = random.Random(3)
    words = "the new york city of rome old Über x".split()
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"The", "the", "New  York", "new-york", "...", "a phrase that is longer than any of the texts are"}
    texts = [" ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(80)] + ["the " * 500, None, "", "New York, New York!"]
    df = spark.createDataFrame([(f"s{i}", t, "x") for i, t in enumerate(texts)], "sample_id string, text string, name string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {}
    for r in gazetteer.mentions(df, table).collect():
        got.setdefault(r.sample_id, []).append((r.at, r.n, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {f"s{i}": m for i, t in enumerate(texts) if (m := brute_mentions(t, names))}
    assert gazetteer.mentions(df, table.filter("false")).count() == 0


def test_sets_replace_the_pattern(spark):
    df = spark.createDataFrame([("1", "Old Rome fell", "rome"), ("2", "nothing", None)], "sample_id string, answer string, context string")
    out = gazetteer.entity_sets(df, spark.createDataFrame([("Rome",), ("old rome",)], "name string")).collect()
    assert {r.sample_id: (r.ent_answer, r.ent_context) for r in out} == {"1": (["old rome"], ["rome"]), "2": ([], [])}
    from riskframe.plans.features import text_features

    made = text_features(gazetteer.entity_sets(df.withColumn("question", df.answer), spark.createDataFrame([("Rome",)], "name string")), ("entity",))
    assert {r.sample_id: r.n_entities_answer for r in made.collect()} == {"1": 1, "2": 0}


def test_rare_terms_give_the_same_cosines(spark, monkeypatch):
    """However few terms go to the tasks, the rest are joined."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("the of the of stone river cloud x_y".split() + [f"w{rng.randrange(40)}"]) for _ in range(rng.choice([0, 1, 30])))
    df = spark.createDataFrame([(str(i), text(), text(), text()) for i in range(60)], KIND)
    weights = semantic.fit_tfidf(df.filter("cast(sample_id as int) < 30"))
    found = []
    for most in (0, 5, 262_144):
        monkeypatch.setattr(semantic, "FREQUENT", most)
        assert semantic.frequent_terms(weights).num_rows <= most
        found.append({r.sample_id: (r.cosine_ctx_ans, r.cosine_q_ans) for r in semantic.tfidf_cosines(weights, df).collect()})
    assert found[0] == found[1] == found[2] and len({x for x, _ in found[0].values()}) > 10


def test_a_batch_of_long_texts_is_counted_in_parts(monkeypatch):
    """3 million terms take the memory of a million; parts give what the whole batch gives."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from riskframe.plans import semantic

    words = [f"w{i}" for i in range(5_000)]
    draw = np.random.default_rng(3).integers(0, len(words), (300, 10_000))
    texts = pa.ListArray.from_arrays(pa.array(np.arange(0, draw.size + 1, draw.shape[1]), pa.int32()), pa.array(words).take(pa.array(draw.ravel())))
    few = pa.array([words[:3]] * len(draw), pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(len(draw))]), pa.array([False] * len(draw)), few, texts, few], ["sample_id", "blank", *semantic.SIDES])
    count = semantic.counter(pa.table({"term": words[::2], "weight": np.arange(2_500.0)}))
    tracemalloc.start()
    made = list(count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    made = pa.Table.from_batches(made).to_pylist()
    monkeypatch.setattr(semantic, "AT_A_TIME", draw.size * 2)
    whole = pa.Table.from_batches(count(iter([batch]))).to_pylist()
    by_term = lambda r: sorted(tuple(t.values()) for t in r["rare"])
    assert [by_term(r) for r in made] == [by_term(r) for r in whole]
    assert all(np.allclose([a[c] for c in semantic.SUMS], [b[c] for c in semantic.SUMS], rtol=1e-12) for a, b in zip(made, whole)) and len(made) == len(whole) == 300
    assert peak < 150_000_000
