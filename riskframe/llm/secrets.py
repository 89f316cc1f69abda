"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates: assignments, access keys and long hexadecimal runs, which are always reported, and long mixed
tokens without a label. Each candidate's value is hashed; hashes are aggregated over the corpus by distinct owners and
repositories. A value that many owners have, or several in many repositories, is a widely copied example; any other is specific
to its owner and looks live. Unlabelled tokens are reported only if they look live and overlap no other span; reported spans
carry their class, so that another owner's copy can turn a live span into an example.

Positions come from the pieces between matches: the lengths of pieces and matches, summed in order, are the offsets.

Defined results: null text is empty; rows alike in id, text, owner and repository get the same spans; a null owner is an owner,
other than an empty one, and so is a null repository; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.llm._shared import staged

#: The patterns of the kinds, in the order in which they are listed.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "token": r"[A-Za-z0-9+/_=-]{20,}",
}
BASE = ("assign", "access", "hex")
#: Documents without this have no candidate.
ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{20}"
LEAST_ASSIGNED = 12


def matches(text: Column, kind: str) -> Column:
    """Matches of a kind as (kind, number, gap before it, length, value, secret part)."""
    pattern = F.lit(KINDS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, KINDS[kind], -1)
    secret = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    no = list(KINDS).index(kind)
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(no).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), F.get(secret, i).alias("secret")
        ),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Spans of (doc_id, text, owner, repo) rows before ownership is known: doc_id, digest of the text, owner, repo, kind, start, end, hash."""
    text = F.coalesce("text", F.lit(""))
    key = ["doc_id", "text_hash", "owner", "repo"]
    found = (
        docs.filter(text.rlike(ANY))
        .select("doc_id", F.xxhash64(text).alias("text_hash"), "owner", "repo", F.explode(F.concat(*[matches(text, k) for k in KINDS])).alias("m"))
        .select(*key, "m.*")
        .withColumn("secret_hash", F.sha2("secret", 256))
        .withColumn("fits", F.expr(f"case kind when 0 then length(secret) >= {LEAST_ASSIGNED} when 3 then secret rlike '[0-9]' and secret rlike '[A-Za-z]' else true end"))
        .drop("secret")
        .dropDuplicates([*key, "kind", "i"])
    )
    end = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy(*key, "kind").orderBy("i"))
    return found.withColumn("end", end).filter("fits").select(*key, "kind", (F.col("end") - F.col("n")).alias("start"), "end", "secret_hash")


def ownership(found: DataFrame) -> DataFrame:
    """(secret_hash, owners, repos): distinct owners of each value, and distinct repositories of owners, over the whole corpus."""
    pairs = found.select("secret_hash", "owner", "repo").distinct().groupBy("secret_hash", "owner").agg(F.count("*").alias("repos"))
    return pairs.groupBy("secret_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source", repo: Column | str = "source",
    example_owners: int = 3, example_repos: int = 4,
) -> DataFrame:
    """For each row: doc_id, base (array of base spans), spans (all), examples and live (numbers of spans by class).

    A span is (start, kind, end, owners, repos, example); kind is its number in KINDS. A value is an example where it is widely
    copied: example_owners owners or more have it, or two or more have it in example_repos repositories or more. One owner's
    value stays live in however many repositories it is.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), col(owner).cast("string").alias("owner"), col(repo).cast("string").alias("repo"))
    found = staged(candidates(docs), "candidates")
    # Stored before candidates join it, so that a value that very many rows have can be dealt to several tasks.
    owned = staged(ownership(found), "ownership")
    example = (F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repos") >= example_repos))
    per_doc = (
        found.join(owned, "secret_hash")
        .groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "owners", "repos", example.alias("example")))).alias("all"))
        .withColumn("base", F.filter("all", lambda s: s["kind"] < len(BASE)))
        .withColumn(
            "extra",
            F.filter("all", lambda s: (s["kind"] >= len(BASE)) & ~s["example"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
        )
        .select("k_id", "k_hash", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))
    )
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = keyed.join(staged(per_doc, "spans"), F.expr("doc_id <=> k_id and text_hash = k_hash"), "left")
    empty = F.array().cast(per_doc.schema["base"].dataType)
    out = out.select("doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))
    examples = F.size(F.filter("spans", lambda s: s["example"])).cast("long")
    return out.withColumn("examples", examples).withColumn("live", F.size("spans").cast("long") - F.col("examples"))


def classes(spans: Column) -> Column:
    """The class of each span, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.when(s["example"], "example").otherwise("live")), ",")
