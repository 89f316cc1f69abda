"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into a fixed number of blocks for each source by a hash, which is a random permutation of the source.
A source's quota is the number of block draws that reach its target: whole passes over the source, then permuted blocks
as far as they fit, and a last one that is cut into sub-blocks to come nearest. The tree starts from all quotas and the whole range of output
shards. Each node puts its draws in a random order and hands the first part to its left half, which is exactly a
multivariate-hypergeometric draw of how many blocks of each source go left; the halves recurse down to single shards. Shards
then take disjoint runs of each source's permuted draws, and rows are shuffled within their shard by hash.

Everything but the two passes over documents works on (source, block) rows, of which there are ``BLOCKS`` for a source. Targets
need the order of all sources, so that one task sorts one row for each of them.
All randomness is hashing under the seed, so reruns agree, lost executors included.

Defined results: null text has no words; a null source is a source, last in order; documents of no words are drawn with
their block and take 0 words; repeated rows are drawn alike; an empty table gives an empty table. Columns of the input
pass through whatever their names; those added begin with ``_mix``, with underscores after where the input has such a name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.llm._shared import fresh, staged

BLOCKS, SUBBLOCKS = 64, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of (source, block) up to which they are sent to every task.
BROADCAST_BLOCKS = 20_000
#: Leading bits of a draw's hash that make a slice.
SLICE_BITS = 10
#: Words that a task sorts, about.
TASK_WORDS = 4_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size) with target: water-filling under the caps most * source_size.

    With sources in order of cap/weight, the level that would hold if the first k were full rises up to the true one and
    falls after it, so the true level is the largest.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    every, after = W.partitionBy(F.lit(1)), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(after.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(after.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.max("at_k").over(every)
    return (
        ranked.withColumn("at_k", (F.sum("source_size").over(every) * share - before) / left)
        .withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
        .select("source", "source_size", "target")
    )


def spread(seed: int, *of: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def filled(parts: str, rest: str, no: str) -> Column:
    """Struct (left, got) of going through parts (o, no, words) in order and taking each that fits in what is left."""
    kind = "cast(array() as array<int>)"
    return F.expr(
        f"aggregate({parts}, struct({rest} as left, {kind} as got), (a, x) -> if(x.words > 0 and x.words <= a.left, "
        f"struct(a.left - x.words as left, array_append(a.got, x.{no}) as got), a))"
    )


def in_order(no: str, seed: int) -> Column:
    return F.array_sort(F.collect_list(F.struct(spread(seed, no).alias("o"), F.col(no), F.col("words"))))


def drawn_blocks(blocks: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(source, block, source_size, target, passes, rest, part): passes whole draws of the block; part is 1 where the last,
    partial pass takes all of the block, 2 where it is cut after rest words, else 0.

    The partial pass goes through the source's permuted blocks and takes those that fit; the smallest other one is cut.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    each = blocks.groupBy("source").agg(in_order("block", seed).alias("parts")).join(targets, F.expr("source <=> t_source")).drop("t_source")
    each = each.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    each = each.withColumn("fill", filled("parts", "rest", "block"))
    cut = F.expr("array_min(transform(filter(parts, x -> x.words > 0 and not array_contains(fill.got, x.block)), x -> struct(x.words, x.block))).block")
    each = each.withColumn("cut", cut)
    return each.select(
        "source", "source_size", "target", "passes", F.col("fill.left").alias("rest"), "cut", "fill.got", F.explode("parts.block").alias("block")
    ).withColumn("part", F.expr("case when array_contains(got, block) then 1 when block = cut and rest > 0 then 2 else 0 end")).drop("cut", "got")


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, quota) to (source_no, shard, quota): each level halves the shard ranges.

    A node's draws are put in the order of their hashes slice by slice, so that no task sorts all of them.
    """
    at = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "source_no", F.col("quota").cast("long").alias("quota"))
    half = F.expr("lo + (hi - lo) div 2")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        token = at.select("lo", "hi", "source_no", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("i"))
        token = token.withColumn("order", spread(seed, "lo", "hi", "source_no", "i")).withColumn("slice", F.shiftrightunsigned("order", 64 - SLICE_BITS))
        token = staged(token, "draws")
        node = W.partitionBy("n_lo", "n_hi")
        slices = token.groupBy(F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), F.col("slice").alias("n_slice")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(node.orderBy("n_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        slices = slices.select("n_lo", "n_hi", "n_slice", before.alias("before"), F.sum("n").over(node).alias("all"))
        local = F.row_number().over(W.partitionBy("lo", "hi", "slice").orderBy("order", "source_no", "i"))
        placed = token.withColumn("local", local).join(slices, F.expr("lo = n_lo and hi = n_hi and slice = n_slice"))
        goes_left = F.col("before") + F.col("local") <= F.round(F.col("all") * (half - F.col("lo")) / (F.col("hi") - F.col("lo")))
        at = staged(
            placed.withColumn("left", F.expr("hi - lo > 1") & goes_left)
            .select(
                F.when(F.expr("hi - lo = 1 or left"), F.col("lo")).otherwise(half).cast("int").alias("lo"),
                F.when(F.col("left"), half).otherwise(F.col("hi")).cast("int").alias("hi"),
                "source_no",
            )
            .groupBy("lo", "hi", "source_no").agg(F.count("*").alias("quota")),
            "nodes",
        )
    return at.select("source_no", F.col("lo").alias("shard"), "quota")


def mixture_plan(sized: DataFrame, weights: list[float], share: float, most: float, shards: int, seed: int) -> DataFrame:
    """Of (source, block, sub, words) rows: one row for each (source, block) with its draws as (pass, shard, partial) and,
    for the block that is cut, the sub-blocks taken."""
    blocks = staged(sized.groupBy("source", "block").agg(F.sum("words").alias("words")), "blocks")
    targets = with_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    at = staged(drawn_blocks(blocks, targets.withColumnRenamed("source", "t_source"), seed), "drawn")
    cut = at.filter("part = 2").select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), "rest")
    subs = (
        sized.join(F.broadcast(cut) if cut.count() <= BROADCAST_BLOCKS else cut, F.expr("source <=> c_source and block = c_block"))
        .groupBy("source", "block", "sub", "rest").agg(F.sum("words").alias("words"))
        .groupBy(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "rest").agg(in_order("sub", seed).alias("parts"))
        .withColumn("fill", filled("parts", "rest", "sub"))
    )
    # One more sub-block where going over by it is nearer than staying below.
    over = F.expr("array_min(transform(filter(parts, x -> x.words > 0 and x.words < 2 * fill.left and not array_contains(fill.got, x.sub)), x -> struct(x.words, x.sub))).sub")
    subs = subs.withColumn("over", over).select("s_source", "s_block", F.array_compact(F.array_append("fill.got", F.col("over"))).alias("subs"))
    draws = at.filter("passes > 0 or part > 0").select(
        "source", "block", F.posexplode(F.expr("transform(array_repeat(false, passes + if(part > 0, 1, 0)), (x, i) -> i >= passes and part = 2)")).alias("pass", "partial")
    )
    draws = draws.withColumn("source_no", spread(seed, "source", F.col("source").isNull()))
    runs = W.partitionBy("source_no")
    draws = draws.withColumn("rank", F.row_number().over(runs.orderBy("pass", spread(seed, "block", "pass"), "block")).cast("long"))
    quotas = split_tree(draws.groupBy("source_no").agg(F.count("*").alias("quota")), shards, seed)
    first = F.coalesce(F.sum("quota").over(runs.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = quotas.withColumn("first", first).select("source_no", "shard", F.explode(F.expr("sequence(first + 1, first + quota)")).alias("rank"))
    taken = (
        draws.join(ranks, ["source_no", "rank"])
        .groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block"))
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "partial"))).alias("draws"))
    )
    return (
        at.join(taken, F.expr("source <=> d_source and block = d_block"), "left")
        .join(subs, F.expr("source <=> s_source and block = s_block"), "left")
        .select(F.col("source").alias("_mix_source"), F.col("block").alias("_mix_block"), "source_size", "target", "draws", "subs")
    )


def _drawn(df: DataFrame, weights: list[float], share: float, most: float, shards: int, seed: int, text_col: str, source_col: str, id_col: str) -> tuple[DataFrame, float]:
    """Columns of df as c0, c1, ... with words, source_size, target and draws; and the words that the mix takes, about."""
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, source, doc = (F.col(f"c{names.index(c)}") for c in (text_col, source_col, id_col))
    sized = rows.select(*rows.columns, source.alias("source"), word_count(text).alias("words"), spread(seed, doc, text).alias("h"))
    sized = sized.withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int"))
    sub = F.pmod(F.shiftright("h", 20), F.lit(SUBBLOCKS)).cast("int")
    plan = staged(mixture_plan(sized.select("source", "block", sub.alias("sub"), "words"), list(weights), share, most, shards, seed), "plan")
    few = plan.count() <= BROADCAST_BLOCKS
    at = sized.join(F.broadcast(plan) if few else plan, F.expr("source <=> _mix_source and block = _mix_block"), "left")
    here = F.filter(F.coalesce("draws", F.array()), lambda d: ~d["partial"] | F.coalesce(F.array_contains("subs", sub), F.lit(False)))
    here = F.transform(here, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    total = plan.select("_mix_source", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    return at.select(*rows.columns, "words", "source_size", "target", here.alias("draws")), total


def mixed(
    df: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 42,
    text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
) -> DataFrame:
    """df with _mix_size, _mix_source_size, _mix_target and _mix_draws (array of (pass, shard)): what the mix takes of each row.

    Sources in code-point order get the weights in turn; together they get share of all words, none more than most times
    its own size.
    """
    drawn, _ = _drawn(df, weights, share, most, shards, seed, text_col, source_col, id_col)
    added = zip(("words", "source_size", "target", "draws"), fresh(df.columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_draws"))
    return drawn.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)], *[F.col(have).alias(name) for have, name in added])


def mixture(
    df: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 42,
    text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
) -> DataFrame:
    """The mix itself: the columns of df, a row for each time it is drawn, in shards that are shuffled within.

    A shard's random order is cut into runs of about ``TASK_WORDS`` words, so that no task sorts a whole shard.
    """
    drawn, total = _drawn(df, weights, share, most, shards, seed, text_col, source_col, id_col)
    rows = drawn.select(*[f"c{i}" for i in range(len(df.columns))], F.explode("draws").alias("draw"))
    whole = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and c != "draw"]
    runs = max(1, math.ceil(total / shards / TASK_WORDS))
    rows = rows.withColumn("order", spread(seed, "draw", *whole)).withColumn("run", F.floor((F.col("order") / 2.0**64 + 0.5) * runs).cast("int"))
    # Each run is a task of its own; hashing runs to tasks would put several in one.
    rows = rows.repartitionById(shards * runs, (F.col("draw.shard") * runs + F.col("run")).cast("int")).sortWithinPartitions("order")
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)])
