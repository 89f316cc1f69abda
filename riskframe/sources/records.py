"""Raw question-answer and response records: reading, normalising, expanding, writing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskframe.functions.text import is_blank, strip

QA_JSON = "question string, knowledge string, right_answer string, answer string, hallucinated_answer string"
CORRUPT = "_corrupt"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where none is set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="riskframe-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/riskframe-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, where several later steps use it.

    By zstd, whose window spans the texts that samples of one document repeat; the default codec looks back over 64 KB only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = QA_JSON, strict: bool = False) -> DataFrame:
    """One JSON object for each line, blank lines left out. Bad lines raise if strict, else are kept under ``_corrupt``."""
    fields = T._parse_datatype_string(schema)
    if strict:
        return spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def number_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """(item_idx, value): position of each non-blank line of text files, in order of file names and lines and without gaps.

    Spark deals the largest files out first, so that the order of partitions isn't that of files.
    """
    from riskframe.operators.prefix import running

    at = F.struct(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("start"), F.monotonically_increasing_id().alias("line"))
    rows = lines.filter(~is_blank(F.col(text_col))).select(text_col, at.alias("_at"), F.lit(1).cast("long").alias("_one"))
    return running(rows, "_at", ["_one"]).select(F.col("before__one").alias("item_idx"), text_col)


def cached_table(df: DataFrame, path: str) -> DataFrame:
    """The table at path, written from df only where nothing is there."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def qa_fields(raw: DataFrame, id_col: str = "id") -> DataFrame:
    """(item_idx, question, context, right_answer, hallucinated_answer), stripped; records without question or right answer go."""
    answer = F.coalesce("right_answer", "answer") if "answer" in raw.columns else F.col("right_answer")
    return raw.select(
        F.col(id_col).cast("long").alias("item_idx"),
        strip(F.col("question")).alias("question"),
        strip(F.col("knowledge")).alias("context"),
        strip(answer).alias("right_answer"),
        strip(F.col("hallucinated_answer")).alias("hallucinated_answer"),
    ).filter("length(question) > 0 and length(right_answer) > 0")


def expand(records: DataFrame) -> DataFrame:
    """(sample_id, item_idx, question, context, answer, label): the right answer, and the hallucinated one unless it is blank."""
    variant = lambda name, answer, label: F.struct(F.lit(name).alias("variant"), F.col(answer).alias("answer"), F.lit(label).alias("label"))
    both = F.array(variant("correct", "right_answer", 0), variant("hallucinated", "hallucinated_answer", 1))
    rows = records.select("item_idx", "question", "context", F.inline(F.filter(both, lambda v: F.length(v["answer"]) > 0)))
    return rows.select(F.concat_ws("_", F.lit("q"), "item_idx", "variant").alias("sample_id"), "item_idx", "question", "context", "answer", "label")


def normalise_responses(raw: DataFrame, task: str = "QA", most: int | None = None) -> DataFrame:
    """(sample_id, question, context, answer, label): annotated responses of one task; the limit comes after the filter, by id."""
    flag = lambda name: F.coalesce(F.col(f"hallucination_labels_processed.{name}"), F.lit(0))
    rows = raw.filter(F.col("task_type") == task)
    rows = rows.orderBy("id").limit(most) if most is not None else rows
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        F.concat(F.lit("ragtruth_"), "id").alias("sample_id"),
        text("query").alias("question"), text("context").alias("context"), text("output").alias("answer"),
        ((flag("evident_conflict") > 0) | (flag("baseless_info") > 0)).cast("int").alias("label"),
    )


def labelled(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["label"])


def in_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def prefix(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def write_tables(clean: DataFrame, path: str) -> None:
    """The clean table by split as Parquet, as JSON lines, and its keys as CSV."""
    clean.write.partitionBy("split").mode("overwrite").parquet(f"{path}/parquet")
    clean.write.mode("overwrite").json(f"{path}/json")
    clean.select("sample_id", "item_idx", "label", "split").write.mode("overwrite").csv(f"{path}/csv", header=True)
