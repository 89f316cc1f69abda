import random

import pytest

from riskframe.operators import splits
from riskframe.sources import records


def test_expand(spark):
    raw = spark.createDataFrame(
        [(1, " q ", "k", None, "a", "h"), (2, " ", "k", "r", None, "h"), (3, "q", None, "r", None, "  ")],
        "id long, question string, knowledge string, right_answer string, answer string, hallucinated_answer string",
    )
    rows = {r.sample_id: r for r in records.expand(records.qa_fields(raw)).collect()}
    assert set(rows) == {"q_1_correct", "q_1_hallucinated", "q_3_correct"}
    assert (rows["q_1_correct"].question, rows["q_1_correct"].answer, rows["q_3_correct"].context) == ("q", "a", "")


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"question": "a"}\n\n{bad\n{"question": "b", "answer": "c"}\n')
    df = records.read_jsonl(spark, str(tmp_path / "x.jsonl")).cache()
    assert df.filter("_corrupt is null").count() == 2 and df.filter("_corrupt is not null").count() == 1
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=True).collect()


def test_line_numbers_have_gaps_only_later(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n\n \nb\nc\n")
    assert sorted((r.item_idx, r.value) for r in records.number_lines(spark.read.text(str(tmp_path / "x.txt"))).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_responses(spark):
    kind = "id string, task_type string, query string, context string, output string, hallucination_labels_processed struct<evident_conflict int, baseless_info int>"
    raw = spark.createDataFrame([("1", "QA", None, "c", "o", None), ("2", "QA", "q", "c", "o", (0, 1)), ("3", "Summary", "q", "c", "o", (1, 1)), ("4", "QA", "q", "c", "o", (None, 0))], kind)
    rows = records.normalise_responses(raw).orderBy("sample_id").collect()
    assert [(r.sample_id, r.label) for r in rows] == [("ragtruth_1", 0), ("ragtruth_2", 1), ("ragtruth_4", 0)] and rows[0].question == ""
    assert records.normalise_responses(raw, most=1).count() == 1


def test_cached_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert records.cached_table(spark.range(3), path).count() == 3
    assert records.cached_table(spark.range(9), path).count() == 3


def frame(spark, n, seed):
    rng = random.Random(seed)
    rows = [(g, label) for g in range(n) for label in (0, 1) if label == 0 or rng.random() < 0.9]
    return spark.createDataFrame([(f"{g}_{label}", g, label) for g, label in rows], "sample_id string, item_idx long, label int")


@pytest.mark.parametrize("n, seed", [(200, 7), (400, 11)])
def test_group_split(spark, n, seed):
    df = frame(spark, n, seed)
    out = splits.with_split(df)
    splits.check_integrity(out)
    assert sorted(out.collect()) == sorted(splits.with_split(df).collect())
    report = {r.split: r for r in splits.integrity(out).collect()}
    assert set(report) == {"train", "val", "test"} and all(r.leakage_free and abs(r.label_mean - 0.5) < 0.15 for r in report.values())
    assert sum(r.groups for r in report.values()) == n


def test_leak_is_found(spark):
    rows = [(0, 0, "train"), (0, 1, "train"), (1, 0, "val"), (1, 1, "val"), (2, 0, "test"), (2, 1, "test")]
    kind = "item_idx long, label int, split string"
    splits.check_integrity(spark.createDataFrame(rows, kind))
    with pytest.raises(splits.LeakageError):
        splits.check_integrity(spark.createDataFrame([(0, 0, "test"), *rows[1:]], kind))


def test_folds_and_samples(spark):
    df = frame(spark, 100, 3)
    by_group = splits.folds(df)
    assert by_group.groupBy("item_idx").agg({"fold": "min"}).count() == 100
    assert by_group.select("item_idx", "fold").distinct().count() == 100
    sizes = [r["count"] for r in splits.folds(df, by="row").groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 3
    assert splits.sample_n(df, 7, "sample_id").count() == 7
    assert {r["count"] for r in splits.sample_each(df, 5, "label", "sample_id").groupBy("label").count().collect()} == {5}
