"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import decontaminate, line_dedup, mixing, near_dedup, quality, runs, secrets, sharding, simhash, top_k, url_filter, variants, warc
from riskframe.llm._shared import read_table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judged(docs, labels, keep=["doc_id"])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, owner="source", repo=F.concat_ws("/", "source", "lang"))
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{kind}") for no, kind in enumerate(secrets.BASE)],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        secrets.classes(F.col("spans")).alias("classes"),
        "examples",
        "live",
    )


def _matches_sql(no: int, kind: str, fits: str, group: int = 0) -> str:
    pattern = secrets.KINDS[kind].replace("'", "''")
    return f"""select doc_id, owner, repo, {no} as k, '{kind}' as kind, unnest(range(1, len(ms) + 1)) as i, ms, vs, gaps, '{fits}' as fits
      from (select *, regexp_extract_all(text, '{pattern}') as ms, regexp_extract_all(text, '{pattern}', {group}) as vs, string_split_regex(text, '{pattern}') as gaps from docs)"""


OP2_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as text, coalesce('=' || source, '') as owner, coalesce('=' || concat_ws('/', source, lang), '') as repo from documents),
found as ({" union all ".join(_matches_sql(i, k, f, g) for i, (k, f, g) in enumerate((("assign", "12", 2), ("access", "1", 0), ("hex", "1", 0), ("token", "mixed", 0))))}),
spans as (select doc_id, owner, repo, k, kind, vs[i] as v, fits, list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda m: length(m))), 0) as start, length(ms[i]) as n from found),
fitting as (select *, start + n as stop from spans where case fits when 'mixed' then regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') else length(v) >= fits::int end),
owned as (select v, count(distinct owner) as owners, count(distinct owner || chr(0) || repo) as repos from fitting group by v),
classed as (select f.*, owners >= 3 or owners >= 2 and repos >= 4 as example from fitting f join owned using (v)),
kept as (select * from classed c where k < 3 or not example and not exists (select 1 from classed b where b.doc_id = c.doc_id and b.k < 3 and b.start < c.stop and c.start < b.stop)),
listed as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, count(*) filter (example) as examples, count(*) filter (not example) as live,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (k < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans,
  string_agg(case when example then 'example' else 'live' end, ',' order by start, k) as classes from kept group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(classes, '') as classes, coalesce(examples, 0) as examples, coalesce(live, 0) as live from docs d left join listed using (doc_id)
"""


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP3_SQL = """
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 20 = 0 and c.r <> q.r)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 20
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.size("_mix_draws")).cast("long").alias("taken"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near").cast("long").alias("n_near"),
    )


OP5_SQL = """
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
tests as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
starts as (select item, ws, unnest(range(1, greatest(2, len(ws) - 11))) as i from tests where len(ws) > 0),
windows as (select distinct item, least(13, len(ws)) as size, array_to_string(list_slice(ws, i, i + 12), ' ') as phrase from starts),
sizes as (select distinct size from windows),
places as (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as pos from words, sizes),
hits as (select doc_id, item, pos, size from (select doc_id, size, pos, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') as phrase from places) join windows using (size, phrase)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from hits) group by doc_id),
named as (select doc_id, list_sort(list(distinct item)) as items from hits group by doc_id),
tokens as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from words),
postings as (select w, count(*) as n from tokens group by w),
terms as (select item, w, n, k from (select item, unnest(ws) as w, unnest(range(len(ws))) as k from tests) join postings using (w)),
anchors as (select item, arg_min(w, struct_pack(n := n, k := k)) as anchor, min(struct_pack(n := n, k := k)).k as pos from terms group by item),
beside as (select item, anchor, w, n, min(k) as k from terms join anchors using (item) where abs(k - pos) <= 4 and w <> anchor group by all),
rarest as (select * from (select *, row_number() over (partition by item order by n, k) as rank from beside) where rank <= 3),
need as (select item, count(*) as n from rarest group by item),
met as (select a.doc_id, r.item, a.p from tokens a join rarest r on a.w = r.anchor join tokens t on t.doc_id = a.doc_id and t.w = r.w and abs(t.p - a.p) <= 8 join need on need.item = r.item
  group by a.doc_id, r.item, a.p, need.n having count(distinct r.w) = need.n),
near as (select doc_id, count(distinct item) as n_near from met group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated, coalesce(n_near, 0) as n_near
from words left join covered using (doc_id) left join named using (doc_id) left join near using (doc_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, strlen(html) as payload_bytes, hex, max(page_id) over (partition by hex) as top from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    (((16 * (strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 1, 1)) - 1) + strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 2, 1)) - 1)
      // [8, 4, 2, 1][(5 * i) % 4 + 1]) % 32)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from d
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


OP7_SQL = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
sets as (select doc_id, list_distinct(case when len(ws) = 0 then [] else list_transform(range(1, greatest(2, len(ws) - 2)), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) end) as s from words),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (select a.doc_id as a, b.doc_id as b from each a join each b using (shingle) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select a as doc_id, b as r from links union select reach.doc_id, links.b from reach join links on reach.r = links.a),
least as (select doc_id, min(r) as r from reach group by doc_id)
select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(r, s.doc_id)) as component_id, s.doc_id <= coalesce(r, s.doc_id) as kept from sets s left join least using (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))


OP8_SQL = """
with recursive docs as (select doc_id, text, md5(text) as digest, string_split(text, chr(10)) as lines from documents),
raw as (select doc_id, digest, unnest(lines) as raw, unnest(range(len(lines))) as line from docs),
tok as (select doc_id, digest, line, list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda t: t <> '') as plain from raw),
wild as (select *, list_transform(plain, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as mask from tok where len(plain) > 0),
lines as (select doc_id, digest, line, case when len(list_filter(mask, lambda t: t <> '<*>')) = 0 then plain else mask end as tokens from wild),
variants as (select tokens, md5(array_to_string(tokens, ' ')) as v, len(tokens)::varchar || ':' || list_slice(tokens, 1, 3)::varchar as leaf from (select distinct tokens from lines)),
alike as (select a.v as a, b.v as b from variants a join variants b using (leaf) where a.v <> b.v
  and 10 * len(list_filter(list_transform(range(1, len(a.tokens) + 1), lambda i: a.tokens[i] = b.tokens[i] and a.tokens[i] <> '<*>'), lambda x: x)) >= 7 * len(a.tokens)),
reach as (select a as v, a as r from alike union select reach.v, alike.b from reach join alike on reach.r = alike.a),
template as (select v, min(r) as t from reach group by v),
places as (select l.doc_id, l.digest, l.line, coalesce(t.t, md5(array_to_string(l.tokens, ' '))) as template from lines l left join template t on t.v = md5(array_to_string(l.tokens, ' '))),
firsts as (select template, min(struct_pack(d := doc_id, l := line)) as first from places group by template having min(doc_id) <> max(doc_id)),
gone as (select doc_id, list(line) as dropped from places join firsts using (template) where struct_pack(d := doc_id, l := line) <> first group by doc_id)
select d.doc_id, coalesce(list_aggregate(list_filter(list_transform(d.lines, lambda x, i: case when list_contains(g.dropped, i - 1) then null else x end), lambda x: x is not null), 'string_agg', chr(10)), '') as text,
  len(d.lines) as n_lines, coalesce(len(g.dropped), 0) as n_dropped
from docs d left join gone g using (doc_id)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


OP9_SQL = """
with rules(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut)
select p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') as verdict
from parts p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
group by all
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, shards=40).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_fingerprints(read_table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, chosen by checksum, go on from some word by repeating what follows it."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("ws", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    docs = docs.withColumn("n", F.size("ws")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    docs = docs.withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> ws[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(looped(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII and Latin-1 letters; t is the list of the 256 steps."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + unicode(c) // 64, 128 + unicode(c) % 64] end))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


_CRC_TABLE = """crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i))"""

OP12_SQL = f"""
with {_CRC_TABLE},
words as (select doc_id, {_crc32_sql("doc_id::varchar")} as h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents, crc),
planned as (select doc_id, ws, len(ws) as n, h, h // 10 as g, case when len(ws) > 0 then (h // 10) % len(ws) end as a from words),
docs as (select doc_id, n, case when h % 10 = 0 and n > 0
  then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else ws end as ws from planned),
tokens as (select doc_id, n, unnest(ws) as w, unnest(range(n)) as i from docs),
pairs as (select x.doc_id, x.i, y.i - x.i as q from tokens x join tokens y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n),
stretches as (select doc_id, q, min(i) as b, max(i) + 1 + q as e from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) group by doc_id, q, k),
found as (select doc_id, b as start, e - b as length, min(q) as period from stretches where e - b >= greatest(24, 3 * q) group by doc_id, b, e),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from found group by doc_id),
best as (select * from found f qualify row_number() over (partition by doc_id order by length * (select (max(period) * max(period))::hugeint from found) // period desc, start, period) = 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from found),
kept as (select doc_id, string_agg(w, ' ' order by i) as text from tokens anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from docs d left join listed using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(variants.word_counts(read_table(spark, sf_dir, "documents"), slip=97))


OP13_SQL = f"""
with recursive {_CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents),
each as (select doc_id, w, count(*) as n from runs group by doc_id, w),
hashed as (select w, n, {_crc32_sql("doc_id::varchar || ':' || w")} as h from each, crc),
spelt as (select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as w, n from hashed),
words as materialized (select w, sum(n)::bigint as n from spelt group by w having length(w) >= 5 and sum(n) >= 3),
places as materialized (select w, n, unnest(range(length(w))) as i from words),
swapped as (select w, n, left(w, i::int) as head, substr(w, i::int + 2) as tail from places),
near as (select x.w, y.w as v, y.n as k from swapped x join swapped y on x.head = y.head and x.tail = y.tail and x.w <> y.w
  union select x.w, y.w, y.n from swapped x join words y on y.w = x.head || x.tail
  union select y.w, x.w, x.n from swapped x join words y on y.w = x.head || x.tail),
best as (select w, count(*) as n_near, arg_min(struct_pack(v := v, k := k), struct_pack(k := -k, v := v)) as b from near group by w),
forms as materialized (select words.w, n, n_near, case when b.k >= 2 * n then b.v end as form, case when b.k >= 2 * n then b.k end as form_n from words left join best using (w)),
chain as (select w, w as root from forms union all select chain.w, f.form from chain join forms f on f.w = chain.root where f.form is not null),
roots as (select chain.w, chain.root from chain join forms f on f.w = chain.root where f.form is null)
select f.w as word, form, root, n, coalesce(n_near, 0) as n_near, form_n from forms f join roots using (w)
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_top_k": op3_top_k,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_sharding": op10_sharding,
    "op11_simhash": op11_simhash,
    "op12_runs": op12_runs,
    "op13_variants": op13_variants,
}
ORACLE_SQL = {"op2_secrets": OP2_SQL, "op3_top_k": OP3_SQL, "op5_decontaminate": OP5_SQL, "op6_warc": OP6_SQL, "op7_near_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_url_filter": OP9_SQL, "op12_runs": OP12_SQL, "op13_variants": OP13_SQL}
