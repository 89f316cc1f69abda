"""The given tables as inputs of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from riskframe.functions.text import NON_SPACE, SPACES, is_blank
from riskframe.sources.records import expand, qa_fields, stored

#: Turns of a conversation that one task orders.
RANGE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, knowledge, right_answer, hallucinated_answer) of documents: first non-blank line, those between, last
    one, and the last line of the document with the next id if it is in the same language."""
    docs = table(spark, sf_dir, "documents").filter(~is_blank(F.col("text")))
    # The outer lines come without cutting up the text, as filters on them are worked out before anything else.
    first = F.regexp_extract("text", f"[^\n]*{NON_SPACE}[^\n]*", 0)
    bare = F.rtrim("text", F.lit(SPACES))
    last = F.substring_index(F.substr("text", F.length(bare) - F.length(F.substring_index(bare, "\n", -1)) + 1), "\n", 1)
    knowledge = F.expr("array_join(slice(ls, 2, greatest(0, size(ls) - 2)), '\n')")
    lines = docs.select("doc_id", "lang", "text").select("doc_id", "lang", first.alias("question"), last.alias("right_answer"), F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_SPACE)).alias("ls"))
    own = lines.select("doc_id", "lang", "question", "right_answer", knowledge.alias("knowledge"))
    # Sorted and merged at every size: a broadcast would leave a small table of one row group in one task. Partitioned by the id alone,
    # so that joins of the samples by their id move no text again; an equality of languages would become a key too.
    after = docs.select((F.col("doc_id") - 1).alias("_id"), F.col("lang").alias("_lang"), last.alias("hallucinated_answer")).hint("merge")
    both = own.join(after, (F.col("doc_id") == F.col("_id")) & F.col("lang").between(F.col("_lang"), F.col("_lang")), "left")
    return both.select(F.col("doc_id").alias("id"), "question", "knowledge", "right_answer", "hallucinated_answer")


def qa_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(qa_fields(qa_raw(spark, sf_dir)))


def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, item_idx, question, context, answer): each assistant turn with the last user and assistant turns before it."""
    turns = table(spark, sf_dir, "conversations")
    text_of = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("turn")))
    # One row for each turn, whatever rows share it: of those of one role the last text counts.
    each = turns.filter("turn is not null").groupBy("conv_id", "turn").agg(
        at("user").alias("u"), at("assistant").alias("a"), text_of("user").alias("u_text"), text_of("assistant").alias("a_text")
    ).withColumn("range", F.expr("turn div " + str(RANGE)))
    each = stored(each, "turns")  # read for the ranges, within them and for both texts
    # Numbers of turns, not texts, are carried: within a range of turns, and from the ranges before it.
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    ranges = each.groupBy("conv_id", "range").agg(F.max("u").alias("u"), F.max("a").alias("a"))
    over = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = ranges.select(F.col("conv_id").alias("r_id"), F.col("range").alias("r_range"), last("u", over).alias("r_u"), last("a", over).alias("r_a"))
    within = W.partitionBy("conv_id", "range").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    known = each.select("conv_id", "turn", "range", "a", last("u", within).alias("own_u"), last("a", within).alias("own_a")).filter("a is not null")
    known = known.join(carried, F.expr("conv_id <=> r_id and range = r_range")).select(
        F.col("conv_id").alias("k_id"), F.col("turn").alias("k_turn"), F.coalesce("own_u", "r_u").alias("q_turn"), F.coalesce("own_a", "r_a").alias("c_turn")
    )
    texts = lambda c: each.filter(f"{c} is not null").select(F.col("conv_id").alias(f"{c}_id"), F.col(c).alias(f"{c}_turn"), F.col(f"{c}_text"))
    known = known.join(texts("u"), F.expr("k_id <=> u_id and q_turn = u_turn"), "left").join(texts("a"), F.expr("k_id <=> a_id and c_turn = a_turn"), "left")
    asked = turns.filter("role = 'assistant'").join(known, F.expr("conv_id <=> k_id and turn = k_turn"), "left")
    return asked.select(
        F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("sample_id"), F.col("conv_id").alias("item_idx"),
        F.coalesce("u_text", F.lit("")).alias("question"), F.coalesce("a_text", F.lit("")).alias("context"), F.col("text").alias("answer"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated responses of documents: every third is another task, labels come from the labels table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flags = labels.select("doc_id", F.struct((1 - F.col("quality")).cast("int").alias("evident_conflict"), F.col("toxic").cast("int").alias("baseless_info")).alias("hallucination_labels_processed"))
    return docs.join(flags, "doc_id", "left").select(
        F.format_string("%08d", "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 2, "Summary").otherwise("QA").alias("task_type"),
        F.col("lang").alias("query"), F.col("source").alias("context"), F.col("text").alias("output"), "hallucination_labels_processed",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, item_idx, label, prob, prob_b) of lineitem, with many ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("sample_id"), F.col("l_orderkey").alias("item_idx"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 50).alias("prob"), (F.col("l_discount") * 10).alias("prob_b"),
    )


def nli_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_idx, six probabilities) of embeddings, three components a direction made to sum to 1."""
    part = lambda at: [F.abs(F.col("embedding")[i].cast("double")) + 0.001 for i in range(at, at + 3)]
    a, b = part(0), part(3)
    names = ("contradiction", "entailment", "neutral")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_idx"),
        *[(x / sum(a[1:], a[0])).alias(f"ctx_{n}") for n, x in zip(names, a)],
        *[(x / sum(b[1:], b[0])).alias(f"ans_{n}") for n, x in zip(names, b)],
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, reply, in_tokens, out_tokens, latency_ms): replies of four styles about labelled documents."""
    said = F.when((F.col("quality") == 0) | (F.col("doc_id") % 11 == 0), "hallucinated").otherwise("grounded")
    body = F.concat(F.lit('{"judgment": "'), said, F.lit('", "confidence": 0.'), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("}"))
    style = F.col("doc_id") % 4
    reply = F.when(style == 0, body).when(style == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(style == 2, F.concat(F.lit("Verdict: "), body, F.lit(" done"))).otherwise(F.concat(F.lit("It is "), said))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", (1 - F.col("quality")).cast("int").alias("label"), reply.alias("reply"),
        F.expr("n_chars div 4 + 50").alias("in_tokens"), F.expr("10 + doc_id % 7").alias("out_tokens"), (F.col("n_chars") % 1000 + 300).cast("double").alias("latency_ms"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("component"), F.col("value").alias("ms"))
