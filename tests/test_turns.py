import random

import pytest

from riskframe import queries_models as qm
from riskframe.sources import records, views


def brute(rows):
    out = []
    for conv, turn, role, text in rows:
        if role == "assistant":
            before = lambda r: max(((t, x or "") for c, t, o, x in rows if c == conv and o == r and t is not None and turn is not None and t < turn), default=(0, ""))[1]
            out.append(("_".join(str(x) for x in ("c", conv, turn) if x is not None), conv, before("user"), before("assistant"), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1024, 5])
def test_turns_against_brute_force(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(views, "RANGE", size)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(-12, 40), None]), rng.choice(["user", "assistant", "system"]), rng.choice([None, "", "a", "b c", f"t{i}"])) for i in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in views.qa_turns(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


def test_no_row_holds_a_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = views.qa_turns(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_lines_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "x" * (i % 7)) for i in range(400)]
    spark.createDataFrame(rows, "item_id long, text string").repartition(4).write.parquet(f"{tmp_path}/benchmark.parquet")
    read = []
    monkeypatch.setattr(records, "number_lines", lambda lines, f=records.number_lines: read.append(lines) or f(lines))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(tuple(r) for r in qm.b4_line_numbers(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(read[0].inputFiles()) > 1
    assert got == [(i, i, len(t)) for i, t in rows]
