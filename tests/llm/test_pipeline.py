import random
import re

import pytest
from pyspark.sql import functions as F

from test_decontaminate import brute as contaminated
from test_near_dedup import brute as groups

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(4)
    bad = [(1000 + i, " ".join(f"{rng.choice(['ab', 'cd'])}{rng.choice(['%%%', '###'])}" for _ in range(30)), "en", "s1", "n", 1, "z", "d") for i in range(60)]
    spark.createDataFrame(bad, docs.schema).union(docs).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, t in enumerate(texts) if t and i < 60] + [(r[0], 0, 0) for r in bad[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, texts[4]), (2, texts[9])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, sf_dir, docs, texts):
    items = [(1, texts[4]), (2, texts[9])]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, sf_dir)
        df.write.parquet(f"{sf_dir}/{name}")
        df = spark.read.parquet(f"{sf_dir}/{name}")
        rows, old = df.collect(), before.collect()
        if name != "shard":
            assert df.columns == before.columns
        if name == "quality":
            assert not any(r.doc_id >= 1000 for r in rows)
            assert {r.doc_id for r in rows} >= {i for i, t in enumerate(texts) if t and t.strip()}
        elif name == "near_dedup":
            want = {i for i, (_, c) in groups(sorted({(r.doc_id, r.text) for r in old}, key=str), 5).items() if i == c}
            assert {r.doc_id for r in rows} == want
            assert len({(r.doc_id, r.text) for r in rows}) == len(rows) < len(old)
        elif name == "decontaminate":
            bad = {i for i, x in contaminated({(r.doc_id, r.text) for r in old}, items).items() if x[3]}
            assert bad and {r.doc_id for r in rows} == {r.doc_id for r in old} - bad
        elif name == "mix":
            words = lambda rs: sum(len(re.findall(r"\S+", r.text or "")) for r in rs)
            assert {r.doc_id for r in rows} <= {r.doc_id for r in old} and words(rows) <= 2 * words(old)
        else:
            assert len(rows) == len(old) and {r._shard for r in rows} <= set(range(40))
            for s in {r._shard for r in rows}:
                assert sorted(r._slot for r in rows if r._shard == s) == list(range(sum(r._shard == s for r in rows)))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"_shard", "_slot", "_size"} <= set(out.columns)


CLASH = "gone long, _gone long, _size long, _shard string, _slot long, _mix_size long, _mix_draws long, score long, held_out long, bucket long, hub long, node long, label string, c0 long, row long, hash long, draw long, `order` long, run long, at long, tie long, `a.b` long, h long, words long, m map<string, long>"


def test_clashing_columns_null_ids_and_repeats(spark, sf_dir, tmp_path):
    """Columns named as any that the stages make, in either case, null ids, ties and repeated rows: nothing crashes, and every stage keeps the columns."""
    names = [c.split()[0].strip("`") for c in CLASH.split(", ")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(spark.createDataFrame([(None, "w " * 30, "en", None), (None, "w " * 30, "en", None), (None, None, None, None), (7_000, "", "en", "s1"), (7_000, "", "en", "s1")], docs.schema))
    values = {"m": F.create_map(F.lit("k"), F.lit(1).cast("long")), "label": F.lit("l"), "_shard": F.lit("mine")}
    docs = docs.withColumns({c: values.get(c, F.lit(5).cast("long")) for c in names if c != "m"}).withColumn("m", values["m"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, stage(spark, df, str(tmp_path))
        if name == "shard":
            assert df.columns == [*before.columns, "_size_", "_shard_", "_slot_"]
        else:
            assert df.columns == before.columns
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert {(r.gone, r._shard) for r in df.collect()} == {(5, "mine")}
        if name == "near_dedup":
            rows = df.groupBy("doc_id", "text").count()
            assert rows.filter("count > 1").count() == 0 and rows.filter("doc_id is null").count() > 0


def test_one_of_repeated_rows(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "a", 2), (1, "b", 3), (None, "a", 4), (None, "a", 4), (2, None, 5), (2, "", 6), (2, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    out = corpus_pipeline.without_repeats(df)
    got = sorted(((r.doc_id, r.text, r.id) for r in out.collect()), key=repr)
    assert [x[:2] for x in got] == sorted({r[:2] for r in rows}, key=repr) and set(got) <= set(rows)
    again = corpus_pipeline.without_repeats(df.orderBy(F.desc("id")).repartition(5))
    assert sorted(((r.doc_id, r.text, r.id) for r in again.collect()), key=repr) == got


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
