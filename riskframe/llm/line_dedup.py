"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, then its first ``DEPTH`` tokens, tokens with digits standing as a
wildcard; a line whose tokens all have digits is taken as it is. Lines at the same leaf that have the same token, not a
wildcard, at ``SIMILAR`` of their positions or more are alike, and lines that are alike, directly or through others, share a
template: more lines can only join templates. A template that occurs in two documents or more is kept at its first place
(smallest id, then line number) and dropped everywhere else.

Alike lines are found without comparing all lines of a leaf. Let a line's tokens be ordered from the rarest to the most common, and let
``most`` be the number that may differ and one more. Of what two alike lines have in common, the first lies among the first
``most`` tokens of both, the second among the first ``most + 1``, and so on (the exact prefix filter, carried on). So lines meet in
buckets of one such token at its position. In a bucket of at most ``SMALL`` distinct lines (``PARTED`` further on) every pair is compared; in a larger one
every line with the bucket's first. Where that leaves a large bucket's lines with several templates, the lines outside its largest one
are open. Up to ``FEW`` open lines are compared with all of the bucket's lines of other templates; a bucket of more is parted by
the next token that its lines have in common, again and again, as long as that holds. Once lines have as many tokens in common as
alike lines need, all are alike, so this ends.
Nothing is capped, and a bucket's pairs are few for each of its lines, so that lines of few values in many fields, as tables have
them, cost no product of their numbers.

Lines are cut and masked once. Only ids and hashes of lines are shuffled, except for one line of each kind in leaves that hold
several, and for documents that lose lines, which are rebuilt at the end.

Defined results: null text stays null and has no lines; lines without tokens always stay; rows alike in id and text count as
one document and lose the same lines; a null id comes first; a text all of whose lines go is empty; an empty table gives an empty
table; other columns play no part; ids that aren't whole numbers raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.llm._shared import known_columns, numbered, staged
from riskframe.llm.components import apart, components

DEPTH = 3
#: Tenths of a line's positions that alike lines have in common.
SIMILAR = 7
#: Distinct lines up to which all pairs of a bucket are compared, and of a bucket that parting another made: rows of buckets cost less than pairs.
SMALL, PARTED = 24, 6
#: Open lines of a bucket that are compared with all of it.
FEW = 6
WILD = "<*>"
#: White space other than spaces and line ends.
BLANKS = "\t\x0b\x0c\r"
#: A token with a digit: no token begins inside another.
FIGURE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
ALL_WILD = r"^<\*>(?: <\*>)*$"
NO_ID = -(1 << 63)


def even_lines(text: Column) -> Column:
    """Lines of a text with their tokens parted by single spaces, worked out on the whole text."""
    blanks = F.when(text.rlike(f"[{BLANKS}]"), F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)
    return F.split(F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " {2,}", " ")).otherwise(blanks), "\n")


def masked(line: Column) -> Column:
    """A line with wildcards for its tokens with digits, unless they all have some."""
    wild = F.regexp_replace(line, FIGURE, WILD)
    return F.when(line.rlike("[0-9]"), F.when(wild.rlike(ALL_WILD), line).otherwise(wild)).otherwise(line)


def leaf_of(norm: Column, n_tokens: Column) -> Column:
    return F.xxhash64(n_tokens, F.substring_index(norm, " ", DEPTH))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, line, leaf, variant) of the lines that have tokens."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("digest"), F.posexplode(even_lines(text)).alias("line", "plain"))
    lines = lines.withColumn("plain", F.trim("plain")).filter("plain != ''").select("doc_id", "digest", "line", masked(F.col("plain")).alias("norm"))
    n_tokens = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return lines.select("doc_id", "digest", "line", leaf_of(F.col("norm"), n_tokens).alias("leaf"), F.xxhash64(F.lit("line"), "norm").alias("variant"))


def distinct_lines(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """(node, leaf, tokens) of one line of each variant, in leaves that hold several."""
    leaves = staged(slim.groupBy("leaf").agg(F.min("variant").alias("low"), F.max("variant").alias("high")).filter("low != high").select("leaf"), "leaves")
    chosen = slim.join(leaves, "leaf").groupBy("variant").agg(F.min(F.struct("doc_id", "digest", "line", "leaf")).alias("at"))
    wanted = chosen.groupBy(F.col("at.doc_id").alias("c_id"), F.col("at.digest").alias("c_digest")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "variant", F.col("at.leaf").alias("leaf"))).alias("chosen"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = rows.join(staged(wanted, "chosen"), F.expr("doc_id = c_id and digest = c_digest"))
    found = found.select(even_lines(F.col("text")).alias("lines"), "chosen").select("lines", F.explode("chosen").alias("c"))
    found = found.select(F.col("c.variant").alias("node"), F.col("c.leaf").alias("leaf"), F.trim(F.get("lines", F.col("c.line"))).alias("plain"))
    return staged(found.dropDuplicates(["node"]).select("node", "leaf", F.split(masked(F.col("plain")), " ").alias("tokens")), "variants")


def tokens_of(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, most, plain, item) for each token, with its leaf and position as one item, of lines that can be alike to others, plain being
    the number of the line's items; and (item, having) of the items that several lines have. Both stored."""
    plain, least = F.size(F.filter("tokens", lambda x: x != WILD)), F.expr(f"({SIMILAR} * size(tokens) + 9) div 10")
    able = own.select("leaf", "node", "tokens", plain.alias("plain"), (plain - least + 1).alias("most")).filter("most > 0")
    each = able.select("leaf", "node", "most", "plain", F.posexplode("tokens").alias("at", "token")).filter(F.col("token") != WILD)
    each = staged(each.select("node", "most", "plain", F.xxhash64("leaf", "at", "token").alias("item")), "tokens")
    return each, staged(each.groupBy("item").agg(F.count("*").alias("having")).filter("having > 1"), "often")


def ranked(each: DataFrame, often: DataFrame) -> DataFrame:
    """(node, most, item, rank) of the items that several lines have, of the lines that have enough of them: rank 1 is a line's rarest.

    Items that only one line has link nothing and come first in rank; a line with fewer others than alike lines need in common is alike to none.
    """
    own = W.partitionBy("node")
    rows = each.join(often, "item").withColumn("shared", F.count("*").over(own)).filter("shared > plain - most")
    rank = F.col("plain") - F.col("shared") + F.row_number().over(own.orderBy("having", "item"))
    return rows.withColumn("rank", rank).select("node", "most", "item", "rank")


def buckets_of(own: DataFrame) -> DataFrame:
    """(bucket, node): the rarest tokens of each line with their leaf and position, as many as two alike lines must share one of."""
    return ranked(*tokens_of(own)).filter("rank <= most").select(F.col("item").alias("bucket"), "node")


def alike(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The (a, b) pairs that have the same token at enough positions."""
    left, right = (own.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    common = F.size(F.filter(F.zip_with("tokens_a", "tokens_b", lambda x, y: (x == y) & (x != WILD)), lambda same: same))
    return pairs.distinct().join(left, "a").join(right, "b").filter(10 * common >= SIMILAR * F.size("tokens_a")).select("a", "b")


def sized(rows: DataFrame) -> DataFrame:
    """rows of buckets of several lines, some of them open, with the bucket's size n and its first line as hub; stored."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.max("opened").alias("some")).filter("n > 1 and some").drop("some")
    return staged(rows.join(staged(counts, "counts"), "bucket"), "buckets")


def open_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of the (bucket, node, opened, label) rows that share a bucket, one of them open, and not a label; null labels differ from all."""
    side = lambda c, some: rows.filter(some).select("bucket", F.col("node").alias(c), F.col("opened").alias(f"opened_{c}"), F.col("label").alias(f"label_{c}"))
    both = side("a", "opened").join(side("b", "true"), "bucket").filter("a != b and (a < b or not opened_b) and not coalesce(label_a = label_b, false)")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(member: DataFrame, most: int) -> DataFrame:
    """(a, b) pairs to compare: all that have an open line in buckets of at most so many lines, and each line with the first in larger ones."""
    star = member.filter(f"n > {most} and node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return open_pairs(member.filter(f"n <= {most}")).union(star)


def templates(own: DataFrame) -> DataFrame:
    """(variant, template) of the variants that share their template with others."""
    each, often = tokens_of(own)
    first = ranked(each, often).filter("rank <= most")
    rows = first.select(F.col("item").alias("bucket"), "node", F.col("rank").alias("last"), F.lit(True).alias("opened"), F.lit(None).cast("long").alias("label"))
    member, depth = sized(staged(rows, "rarest")), 1
    links = staged(alike(candidates(member, SMALL), own), "alike")
    found = components(links)
    large = member.filter(f"n > {SMALL}").select("bucket", "node", "last")
    while large is not None:
        rows = staged(apart(large.drop("last"), found).join(large, ["bucket", "node"]), "apart")
        if not rows.limit(1).count():
            break
        counts = staged(rows.groupBy("bucket").agg(F.sum(F.col("opened").cast("int")).alias("open")), "open")
        few, many = (rows.join(counts.filter(c), "bucket", "left_semi") for c in (f"open <= {FEW}", f"open > {FEW}"))
        pairs, large = open_pairs(few), None
        if counts.filter(f"open > {FEW}").limit(1).count():
            depth, many = depth + 1, staged(many, "many")
            more = ranked(each.join(staged(many.select("node").distinct(), "nodes"), "node", "left_semi"), often).filter(f"rank <= most + {depth - 1}")
            many = many.join(more, "node").filter("rank > last")
            member = sized(staged(many.select(F.xxhash64("bucket", "item").alias("bucket"), "node", F.col("rank").alias("last"), "opened", "label"), "parted"))
            pairs, large = pairs.union(candidates(member, PARTED)), member.filter(f"n > {PARTED}").select("bucket", "node", "last")
        fresh = staged(alike(pairs, own), "more")
        if fresh.limit(1).count():
            links = links.union(fresh)
            found = components(links)
    return found.select(F.col("node").alias("variant"), F.xxhash64(F.lit("template"), "label").alias("template"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, dropped): numbers of the lines that go, for documents (by id and hash of the text) that lose any."""
    docs = known_columns(numbered(df, id_col), doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = staged(lines_of(docs), "lines")
    template = staged(templates(distinct_lines(docs, slim)), "templates")
    places = slim.join(template, "variant", "left").select("doc_id", "digest", "line", F.coalesce("template", "variant").alias("template"))
    # Templates of several documents are stored before lines join them: one that very many lines have is then dealt to several tasks.
    places = staged(places, "places")
    several = places.groupBy("template").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id != last_id")
    again = staged(places.join(staged(several.select("template", "first_id"), "several"), "template"), "again")
    first = again.filter("doc_id = first_id").groupBy("template").agg(F.min(F.struct("line", "digest")).alias("first"))
    gone = again.join(staged(first, "firsts"), "template").filter("doc_id != first_id or struct(line, digest) != first").select("doc_id", "digest", "line")
    return gone.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row, the text without its dropped lines."""
    gone = staged(dropped_lines(df, id_col, text_col).withColumnsRenamed({"doc_id": "g_id", "digest": "g_digest"}), "dropped")
    docs = known_columns(df, **{"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")
    joined = docs.select("*", *key).join(gone, F.expr("key = g_id and hash = g_digest"), "left")
    # One flag for each line up to the last that goes; looking each number up would be quadratic in a text's lines.
    runs = F.expr("transform(dropped, (d, i) -> concat(repeat('0', d - if(i = 0, -1, dropped[i - 1]) - 1), '1'))")
    joined = joined.withColumn("lines", F.split("text", "\n")).withColumn("flags", F.split(F.array_join(runs, ""), ""))
    left = F.expr("transform(filter(zip_with(lines, flags, (l, f) -> struct(l, f)), x -> x.l is not null and not (x.f <=> '1')), x -> x.l)")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        F.col("doc_id").alias(id_col), text.alias(text_col),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
