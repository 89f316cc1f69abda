import random
import zlib

import pytest

from riskframe.llm import line_dedup, sharding, url_filter


def kept(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, raw string, line int")
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}


def test_exact_and_variable_lines(spark):
    out = kept(
        spark, "All rights reserved by us in 1999\nfirst own line of text\nshort", "second own line here now\nAll rights reserved by us in 2004", "short\n\nAll rights reserved by us in 7",
        "Mail to our friend ann today please dear reader\nx", "Mail to our friend bob today please dear reader", None, "",
    )
    assert out[0] == ("All rights reserved by us in 1999\nfirst own line of text\nshort", 3, 0)
    assert out[1] == ("second own line here now", 2, 1) and out[2] == ("", 3, 2)
    assert out[3][2] == 0 and out[4] == ("", 1, 1) and out[5] == (None, 0, 0) and out[6] == ("", 1, 0)


def test_lines_of_any_length(spark):
    out = kept(spark, "Page 3\n12 2019\n\t \n很长的一行", "Page 4\n13 2020\n\t \n很长的一行", "Page  77 ", "12 2019")
    assert [out[i] for i in range(4)] == [("Page 3\n12 2019\n\t \n很长的一行", 4, 0), ("13 2020\n\t ", 4, 2), ("", 1, 1), ("", 1, 1)]


MAIL = "Mail to our friend {} today please dear {} reader of this paper"


def test_more_lines_never_part_alike_ones(spark):
    """Two lines that are alike stay so whatever else their leaf holds, and a leaf can have several templates."""
    texts = [MAIL.format("ann", "old"), MAIL.format("bob", "old")]
    assert kept(spark, *texts)[1][2] == 1
    others = ["Mail to our " + " ".join(f"w{c}{i}" for i in "abcdefghi") for c in "stuvxyz"]
    out = kept(spark, *texts, MAIL.format("ann", "new"), *others, others[0] + "", others[1].replace("wti", "else"))
    assert [out[i][2] for i in range(12)] == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_common_tokens_bring_no_unlike_lines_together(spark):
    """Lines of one leaf that share half their tokens share none of their rarest."""
    own = spark.createDataFrame([(i, 1, ["a", "b", "c", "d", "e", *[f"x{i}y{k}" for k in range(5)]]) for i in range(50)] + [(99, 1, ["a", "1", "<*>", "<*>", "<*>", "d", "e", "f", "<*>", "g"])], "node long, leaf long, tokens array<string>")
    assert line_dedup.buckets_of(own).count() == 0


def test_few_values_in_many_fields_cost_no_product(spark, monkeypatch):
    """8,000 lines of three fixed tokens and seven fields of 20 values, which have 10 million pairs with a rarest token in common."""
    compared = []
    real = line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs, own: compared.append(pairs.distinct().count()) or real(pairs, own))
    rng = random.Random(8)
    lines = {("for", "the", "row", *(f"f{i}v{rng.randrange(20)}" for i in range(7))) for _ in range(8000)}
    own = spark.createDataFrame([(i, 1, list(x)) for i, x in enumerate(sorted(lines))], "node long, leaf long, tokens array<string>")
    line_dedup.templates(own).count()
    assert sum(compared) < 40 * len(lines)


def test_many_lines_of_few_values_against_all_pairs(spark, monkeypatch):
    """Buckets that are parted several times, against all pairs of the leaf."""
    monkeypatch.setattr(line_dedup, "SMALL", 3)
    monkeypatch.setattr(line_dedup, "PARTED", 2)
    rng = random.Random(12)
    lines = sorted({("a", "b", "c", *(f"f{i}v{rng.randrange(4 if i < 3 else 9)}" for i in range(7))) for _ in range(400)})
    own = spark.createDataFrame([(i, 1, list(x)) for i, x in enumerate(lines)], "node long, leaf long, tokens array<string>")
    found = {r.variant: r.template for r in line_dedup.templates(own).collect()}
    of = brute_templates(lines)
    groups = {}
    for i, x in enumerate(lines):
        groups.setdefault(of[x], set()).add(found.get(i, ("alone", i)))
    assert all(len(g) == 1 for g in groups.values()) and len(set(map(frozenset, groups.values()))) == len(groups)
    assert 1 < len(groups) < len(lines)


def brute_templates(lines):
    """Template of each line (tokens), by comparing all lines of a leaf."""
    up = {x: x for x in lines}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if len(a) == len(b) and a[:3] == b[:3] and 10 * sum(x == y != "<*>" for x, y in zip(a, b)) >= 7 * len(a):
                up[top(a)] = top(b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("small", [24, 1])
def test_against_all_lines_of_a_leaf(spark, monkeypatch, small):
    """With small = 1 every bucket takes the way of large ones."""
    import random

    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(3)
    lines = []
    for _ in range(150):
        n = rng.choice([2, 4, 5, 7, 10, 11])
        lines.append(tuple(["a", "b", "c"][:n] + [rng.choice("xy") for _ in range(n - 3)]) if rng.random() < 0.9 else tuple(f"{rng.choice('pq')}{rng.randint(0, 9)}" for _ in range(n)))
    mask = lambda t: t if all(any(c.isdigit() for c in x) for x in t) else tuple("<*>" if any(c.isdigit() for c in x) else x for x in t)
    of = brute_templates([mask(x) for x in lines])
    places, want = {}, []
    for i, x in enumerate(lines):
        places.setdefault(of[mask(x)], []).append(i)
    for i, x in enumerate(lines):
        want.append(int(places[of[mask(x)]][0] != i))
    out = kept(spark, *[" ".join(x) for x in lines])
    assert [out[i][2] for i in range(len(lines))] == want


def test_lines_that_differ_stay(spark):
    out = kept(spark, "one two three four five six", "one two three nine ten twelve")
    assert out[0][2] == out[1][2] == 0


def test_repeats_within_a_document_stay(spark):
    assert kept(spark, "one two three four\none two three four")[0][2] == 0
    assert kept(spark, "one two three four\none two three four", "one two three four")[0] == ("one two three four", 2, 1)


def test_line_edge_cases(docs, no_docs, texts):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and line_dedup.dedup_lines(no_docs).count() == 0
    assert all((r.text is None) == (texts[r.doc_id] is None) for r in out.collect())


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("same.io", "/", "block"), ("same.io", "/", "allow")]
URLS = [
    ("http://a.example.net/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://EXAMPLE.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"), ("http://x.example.com/de/1#f", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"), ("http://h.net:80/", "h.net:80", "/", None, "allow"), ("x://same.io/?", "same.io", "/", "same.io/", "allow"), ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    ("http://" + "a." * 5000 + "net/" + "p/" * 5000, "a." * 5000 + "net", "/" + "p/" * 5000, "net/", "block"),
]


@pytest.mark.parametrize("most", [50_000, 1])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rows = [(i, u[0], "h", "r", "p") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, host string, rule string, path string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(RULES, url_filter.RULE_SCHEMA))
    assert out.count() == len(URLS) + 1
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]


def test_many_rules_against_plain_loops(spark):
    """Hundreds of path lengths, in rules that share hosts and paths, with and without a slash at their end."""
    import random

    rng = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "x", "y.x"]
    rules = sorted({(rng.choice(hosts), "/" + "p" * rng.randint(0, 300) + rng.choice(["", "/"])): rng.choice(["allow", "block"]) for _ in range(400)}.items())
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts + ['z'])}/{'p' * rng.randint(0, 320)}{rng.choice(['', '/q', '?p', '#'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame([(h, p, v) for (h, p), v in rules], url_filter.RULE_SCHEMA))
    for r in out.collect():
        fits = [(len(h + p), h.count("."), h + p, v) for (h, p), v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert url_filter.judge_urls(pages, none).first().verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


@pytest.mark.parametrize("sort_rows", [20_000, 50])
def test_shards(spark, sort_rows):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 10, sort_rows=sort_rows).collect()
    sizes, slots, of_text = [0] * 10, {}, {}
    for r in out:
        assert r._size == len((r.text or "").encode()) + 16
        sizes[r._shard] += r._size
        slots.setdefault(r._shard, []).append(r._slot)
        of_text.setdefault(r.text, set()).add(r._shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 3000
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 10
    assert all(len(s) == 1 for t, s in of_text.items() if t not in ("same text", "")) and len(of_text["same text"]) < 4


def test_shards_against_sorting_all_rows(spark):
    """The law by brute force: rows in order of their keys, cut where the bytes before reach each shard's share."""
    import xxhash

    rows = [(i, None if i % 50 == 0 else "same text" if i % 3 == 0 else "x" * (i % 90)) for i in range(2000)]
    shards, tolerance = 7, 0.002
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards, tolerance=tolerance).collect()

    def key(i, text):
        high, low = xxhash.xxh64(b"text", 42).intdigest(), xxhash.xxh64(b"row", 42).intdigest()
        high = high if text is None else xxhash.xxh64(text.encode(), high).intdigest()
        low = xxhash.xxh64(i.to_bytes(8, "little"), low).intdigest()
        low = low if text is None else xxhash.xxh64(text.encode(), low).intdigest()
        return high >> 32 << 32 | low & 0xFFFFFFFF

    ordered = sorted(out, key=lambda r: key(r.doc_id, r.text))
    total, below, slots = sum(r._size for r in out), 0, [0] * shards
    assert [r._shard for r in ordered] == sorted(r._shard for r in out)
    for r in ordered:
        assert r._size == len((r.text or "").encode()) + 16 and r._slot == slots[r._shard]
        slots[r._shard] += 1
        share = total / shards
        slack = tolerance * share + 200  # the largest row
        assert r._shard * share - slack <= below <= (r._shard + 1) * share + slack
        below += r._size


def test_clashing_shard_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "_slot long, text string, _SIZE long, _shard long, _shard_ long")
    out = sharding.shard_by_bytes(df, 3)
    assert out.columns == [*df.columns, "_size_", "_shard__", "_slot_"] and out.first()["_size_"] == 17 and out.first()["_slot"] == 1


def test_shard_edge_cases(docs, no_docs, texts):
    out = sharding.shard_by_bytes(docs, 40)
    assert out.columns == [*docs.columns, "_size", "_shard", "_slot"] and out.count() == docs.count()
    assert sorted(zlib.crc32((r.text or "").encode()) for r in out.collect()) == sorted(zlib.crc32((r.text or "").encode()) for r in docs.collect())
    assert sharding.shard_by_bytes(no_docs, 40).count() == 0
    again = {(r.doc_id, r._shard, r._slot) for r in sharding.shard_by_bytes(docs.repartition(7), 40).collect()}
    assert again == {(r.doc_id, r._shard, r._slot) for r in out.collect()}
