import pytest

from riskframe.llm import decontaminate, line_dedup, near_dedup


def test_ids_that_are_no_whole_numbers_raise(spark):
    df = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for f in (near_dedup.near_duplicates, line_dedup.dedup_lines, lambda x: decontaminate.contamination(x, items)):
        with pytest.raises(ValueError, match="ids must be whole numbers"):
            f(df)
