"""URL filters: hashed host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

Each URL is expanded into the expressions a rule could be written as, in two steps: its host suffixes, of as many labels as
some rule's host has, meet the rules' hosts, and each that is one is followed by the path prefixes that are as long as a path of
that host's rules. Both times the equi-join is on the first bytes of SHA-256; the full digests are compared afterwards,
and the longest rule decides. A list of rules with very many path lengths thus expands a URL only by those of its own hosts.

Defined results: a null URL or one without ``://`` has empty host and path, and no rule fits it; an empty table gives an
empty table; repeated rows each get their row; very long URLs are expanded whole; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm._shared import ascii_lower, known_columns, staged

RULE_SCHEMA = "host string, path string, verdict string"
#: Rules up to this many are sent to every task (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Hexadecimal digits of the digest that the join compares.
SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def labels(host: Column) -> Column:
    """Number of dot-separated labels."""
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row for each rule expression with its digests; of equal expressions an allowing one wins."""
    return (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host != '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("rule_verdict"))
        .select(
            "host",
            F.concat("host", "path").alias("rule"),
            "rule_verdict",
            labels(F.col("host")).alias("n_labels"),
            F.length("path").alias("path_length"),
        )
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def hashed(df: DataFrame, of: str, full: str, short: str) -> DataFrame:
    """df with the SHA-256 of a column, and its first digits."""
    return df.withColumn(full, F.sha2(of, 256)).withColumn(short, F.substring(full, 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; default is the verdict where no rule fits.

    Only distinct (host, path) pairs are expanded, so that a much repeated URL is judged once. Rules, hosts and verdicts of pairs
    are stored before rows join them, so that a host or URL that very many rows have can be dealt to several tasks.
    """
    ready = staged(prepared_rules(rules), "rules")
    hosts = ready.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set("path_length").alias("lengths"))
    hosts = staged(hashed(hosts, "rule_host", "host_digest", "host_short"), "hosts")
    counts = sorted(r.n for r in ready.select(F.col("n_labels").alias("n")).distinct().collect())  # host names have few labels
    few = ready.count() <= BROADCAST_RULES
    sent = F.broadcast if few else lambda df: df
    host, path = split_url(F.col("url"))
    urls = known_columns(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    suffixes = F.filter(F.array(*[F.lit(n) for n in counts]).cast("array<int>"), lambda n: n <= labels(F.col("host")))
    each = urls.filter("host != ''").select("host", "path").distinct().select("host", "path", F.explode(F.transform(suffixes, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("suffix"))
    known = hashed(each, "suffix", "suffix_digest", "host_short").join(sent(hosts), "host_short").filter("suffix_digest = host_digest")
    wanted = known.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    wanted = hashed(wanted.select("host", "path", F.expr("concat(suffix, substring(path, 1, n))").alias("expression")), "expression", "full", "short")
    fits = (
        wanted.join(sent(ready.select("rule", "rule_verdict", "n_labels", "digest", "short")), "short")
        .filter("full = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "n_labels", "rule", "rule_verdict")).alias("best"))
    )
    # Merged at every size: verdicts grow with the pages, and take far more memory than their compressed file.
    return urls.join(staged(fits, "fits").hint("merge"), ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
