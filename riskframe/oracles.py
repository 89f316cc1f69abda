"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

from riskframe.functions.measures import PLAIN_NAMES
from riskframe.functions.text import HEDGES
from riskframe.operators.errors import CATEGORIES, COST_PER_1000, DEFAULTS
from riskframe.operators.perturb import NAME
from riskframe.operators.stats import LARGE, SCORE_KEY, TRIES, poisson_one_sql, poisson_trial_sql
from riskframe.plans.features import GROUPS

SP = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
NB = f"[^{SP}]"
ENTITY = r"\p{Lu}[\p{L}\p{N}_]*(?:\x20\p{Lu}[\p{L}\p{N}_]*)*|\p{Nd}+(?:[.,/-]\p{Nd}+)*%?"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{SP}]+|[{SP}]+$', '', 'g')"


RAW = f"""
own as (select doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NB}')) as ls from documents),
own2 as (select doc_id, lang, ls[1] as question, coalesce(array_to_string(ls[2:len(ls) - 1], chr(10)), '') as knowledge, ls[len(ls)] as right_answer from own where len(ls) > 0),
qa_raw as (select a.doc_id as id, a.question, a.knowledge, a.right_answer, b.right_answer as hallucinated_answer from own2 a left join own2 b on b.doc_id = a.doc_id + 1 and b.lang = a.lang),
records as (select * from (select id as item_idx, {strip('question')} as question, {strip('knowledge')} as context, {strip('right_answer')} as right_answer, {strip('hallucinated_answer')} as hallucinated_answer from qa_raw) where length(question) > 0 and length(right_answer) > 0),
qa as (select 'q_' || item_idx || '_correct' as sample_id, item_idx, question, context, right_answer as answer, 0 as label from records
  union all select 'q_' || item_idx || '_hallucinated', item_idx, question, context, hallucinated_answer, 1 from records where length(hallucinated_answer) > 0)
"""


def tok(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def num(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\b\d+(?:\.\d+)?%?\b'))"


def ent(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '{ENTITY}'), lambda e: lower(e)))"


HEDGE = " + ".join(f"(length(lower(answer)) - length(replace(lower(answer), '{h}', ''))) // {len(h)}" for h in HEDGES)
both = "len(list_intersect({a}, {b}))".format
FEATURES = f"""{RAW},
sets as (select *, {tok('answer')} as ta, {tok('context')} as tc, {tok('question')} as tq, {num('answer')} as na, {num('context')} as nc, {ent('answer')} as ea,
  case when regexp_matches(context, '{NB}') then {ent('context')} else [] end as ec, len(regexp_extract_all(answer, '{NB}+')) as nw, {HEDGE} as hc from qa),
features as (select sample_id, item_idx, question, context, answer, label, length(answer) as n_chars, nw as n_words,
  greatest(1, len(list_filter(string_split_regex(answer, '[.!?]+'), lambda s: regexp_matches(s, '{NB}')))) as n_sentences,
  length(answer)::double / greatest(1, nw) as avg_word_len,
  case when len(ta) = 0 then 0.0::double else {both(a='ta', b='tc')}::double / len(ta) end as overlap_answer_context,
  case when len(ta) = 0 then 0.0::double else {both(a='ta', b='tq')}::double / len(ta) end as overlap_answer_question,
  case when len(ta) = 0 then 0.0::double else {both(a='ta', b='tc')}::double / (len(ta) + len(tc) - {both(a='ta', b='tc')}) end as jaccard_ans_ctx,
  case when len(ta) = 0 then 0.0::double else {both(a='ta', b='tq')}::double / (len(ta) + len(tq) - {both(a='ta', b='tq')}) end as jaccard_ans_q,
  len(ea) as n_entities_answer, len(ec) as n_entities_context,
  case when len(ea) = 0 then 1.0::double else round_even({both(a='ea', b='ec')}::double / len(ea), 6) end as entity_overlap_ratio,
  case when len(ea) = 0 then 0.0::double else round_even((len(ea) - {both(a='ea', b='ec')})::double / len(ea), 6) end as novel_entity_ratio,
  len(na) as n_numbers_answer, len(nc) as n_numbers_context,
  case when len(na) = 0 then 1.0::double else {both(a='na', b='nc')}::double / len(na) end as number_overlap_ratio,
  len(na) - {both(a='na', b='nc')} as novel_numbers,
  hc as hedge_count, hc::double / greatest(1, nw) as hedge_density from sets)
"""
LENGTH = "n_chars, n_words, n_sentences, avg_word_len"
LEXICAL = "overlap_answer_context, overlap_answer_question, jaccard_ans_ctx, jaccard_ans_q"
NUMERIC = "n_numbers_answer, n_numbers_context, number_overlap_ratio, novel_numbers"
ENTITIES = "n_entities_answer, n_entities_context, entity_overlap_ratio, novel_entity_ratio"
HEDGING = "hedge_count, hedge_density"
LABELS = "case when {p} >= 0.7 then 'high_risk' when {p} >= 0.3 then 'medium_risk' else 'low_risk' end".format
CLAMP = "least(0.999::double, greatest(0.001::double, {p}))".format

SPLIT = f"""{RAW},
groups as (select item_idx, max(label) as stratum from qa group by item_idx),
ranked as (select *, row_number() over (partition by stratum order by md5('42:' || item_idx), item_idx) as rank, count(*) over (partition by stratum) as total from groups),
splits as (select item_idx, case when 100 * rank <= 70 * total then 'train' when 100 * rank <= 85 * total then 'val' else 'test' end as split from ranked),
split_qa as (select qa.*, split from qa join splits using (item_idx))
"""
PRED = """
pred as (select l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || l_extendedprice::decimal(18,2) as sample_id, l_orderkey as item_idx, (l_returnflag = 'R')::int as label, l_quantity / 50 as prob, l_discount * 10 as prob_b,
  (l_quantity / 50 >= 0.5)::int as pred, (l_discount * 10 >= 0.5)::int as pred_b from lineitem)
"""
SCORES = f"""{PRED},
scores as (select prob as score, sum(label)::bigint as pos, (count(*) - sum(label))::bigint as neg from pred group by prob),
cum as (select *, coalesce(sum(pos) over w, 0)::bigint as bp, coalesce(sum(neg) over w, 0)::bigint as bn, sum(pos) over ()::bigint as ap, sum(neg) over ()::bigint as an
  from scores window w as (order by score desc rows between unbounded preceding and 1 preceding))
"""
CONFUSION = """select sum((pred = 1 and label = 1)::int)::double as tp, sum((pred = 1 and label = 0)::int)::double as fp, sum((pred = 0 and label = 1)::int)::double as fn,
  sum((pred = 0 and label = 0)::int)::double as tn"""
POINT = """tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1,
  (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as mcc, (tp + tn) / (tp + fp + fn + tn) as accuracy"""
EDGE = " + ".join(f"(prob >= {i * 0.1!r}::double)::int" for i in range(10)) + " + (prob >= 1.0)::int"
BIN = f"least(9, greatest(0, {EDGE} - 1))"
NLI_PART = "abs(embedding[{i}]::double) + 0.001".format
NLI = "nli as (select vec_id as item_idx, " + ", ".join(
    f"({NLI_PART(i=at + k + 1)}) / (({NLI_PART(i=at + 1)}) + ({NLI_PART(i=at + 2)}) + ({NLI_PART(i=at + 3)})) as {side}_{name}"
    for side, at in (("ctx", 0), ("ans", 3)) for k, name in enumerate(("c", "e", "n"))
) + " from embeddings)"
NLI_QA = f"""{FEATURES}, {NLI},
nli_qa as (select f.*, {', '.join(f"case when regexp_matches(context, '{NB}') then round_even({c}, 6) else round_even(1.0::double / 3, 6) end as {n}" for c, n in (
  ('ctx_e', 'nli_ctx_entails_ans'), ('ctx_c', 'nli_ctx_contradicts_ans'), ('ctx_n', 'nli_ctx_neutral_ans'), ('ans_e', 'nli_ans_entails_ctx'), ('ans_c', 'nli_ans_contradicts_ctx'), ('ans_n', 'nli_ans_neutral_ctx')))}
  from features f left join nli using (item_idx)),
risk as (select *, 1 - overlap_answer_context as prob, (1 - overlap_answer_context >= 0.5)::int as pred from nli_qa)
"""
TAG = """case when n_words <= 4 then 'short_answer_ambiguity'
  when coalesce(nli_ctx_entails_ans, 0) > 0.8 and overlap_answer_context > 0.6 then 'label_ambiguity' when coalesce(nli_ctx_contradicts_ans, 0) > 0.5 and overlap_answer_context < 0.3 then 'label_ambiguity'
  when n_entities_answer = 0 then 'entity_extraction_failure' when length(context) < 80 then 'weak_context' when length(answer) < 40 and n_words <= 8 then 'short_answer_ambiguity'
  when overlap_answer_context > 0.6 then 'unsupported_but_semantically_similar' else 'other' end"""
ERR = f"""{NLI_QA}, err as (select *, case when pred = 1 then 'false_positive' else 'false_negative' end as error_type, {TAG} as category from risk where pred <> label)"""
REPLY = """
verdicts as (select l.doc_id, 1 - l.quality as label, case when l.quality = 0 or l.doc_id % 11 = 0 then 'hallucinated' else 'grounded' end as said, (l.doc_id % 9 + 1) / 10.0::double as conf, l.doc_id % 4 as style,
  d.n_chars // 4 + 50 as in_tokens, 10 + l.doc_id % 7 as out_tokens, (d.n_chars % 1000 + 300)::double as latency_ms from labels l join documents d using (doc_id))
"""

#: Columns of the given tables with what makes their text.
TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey s_acctbal:f",
    "customer": "c_custkey c_name c_nationkey c_acctbal:f c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:f",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:f props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:l label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
TEXT = {"": "{c}::varchar", "f": "round({c} * 1e6)::bigint::varchar", "t": "epoch_us({c})::varchar", "l": "array_to_string(list_transform({c}, lambda x: round(x::double * 1e6)::bigint::varchar), ',')"}


def manifest_row(name: str) -> str:
    texts = [f"coalesce({TEXT[kind].format(c=c)}, '~')" for c, _, kind in (x.partition(":") for x in TABLES[name].split())]
    return f"select '{name}' as table_name, count(*) as rows, coalesce(sum(('0x' || substr(md5(concat_ws('|', {', '.join(texts)})), 1, 8))::bigint), 0)::bigint as content from {name}"


#: The complementary error function of x >= 0 by its series; beyond 4 it is 0 to seven places.
ERFC = "case when {x} > 4 then 0.0::double else 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (case when k % 2 = 0 then 1 else -1 end) * exp((2 * k + 1) * ln({x}::double) - lgamma(k + 1.0::double)) / (2 * k + 1))) end"
MCNEMAR = "pow(abs(b - c) - 1, 2)::double / nullif(b + c, 0)"


def mcnemar_p(statistic: str) -> str:
    x = f"sqrt({statistic} / 2)"
    return f"round(case when b + c = 0 then 1.0::double when {statistic} = 0 then 1.0::double else {ERFC.format(x=x)} end, 6)"


def perturbed(name: str, answer: str) -> str:
    features = FEATURES.replace("as hc from qa)", f"as hc from (select * replace ({answer} as answer) from qa))")
    return f"select * from (with {features} select '{name}' as perturbation, round(avg(overlap_answer_context), 6) as overlap, round(avg(novel_numbers), 6) as novel_numbers, round(avg(novel_entity_ratio), 6) as novel_entities, count(*) as rows from features)"


LINEAR = {"n_words": 0.1, "n_sentences": -0.3, "overlap_answer_context": -2.0, "jaccard_ans_q": 1.5}
IMPACTS = f"""{FEATURES}, means as (select {', '.join(f'avg({c}) as mean_{c}' for c in LINEAR)} from features),
impacts as ({' union all '.join(f"select sample_id, '{c}' as feature, {c}::double as value, {w}::double * ({c} - mean_{c}) as impact from features, means" for c, w in LINEAR.items())})
"""
TURNS = """turns as (select conv_id, turn, role, text as answer, coalesce(last_value(case when role = 'user' then text end ignore nulls) over w, '') as question,
  coalesce(last_value(case when role = 'assistant' then text end ignore nulls) over w, '') as context from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))"""
SCALED = [f for g in GROUPS if g != "semantic" for f in GROUPS[g]]

TERMS = f"""{SPLIT},
told as (select sample_id, split, context, 0 as side, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) as term from split_qa
  union all select sample_id, split, context, 1, unnest(regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}_]+')) from split_qa
  union all select sample_id, split, context, 2, unnest(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+')) from split_qa),
counts as (select sample_id, any_value(split) as split, term, count(*) filter (side = 0) as nq, count(*) filter (side = 1) as nc, count(*) filter (side = 2) as na from told group by sample_id, term),
texts as (select 2 * count(*) as n from split_qa where split = 'train'),
seen as (select term, sum((nc > 0)::int + (na > 0)::int)::bigint as df from counts where split = 'train' group by term),
weighed as (select sample_id, nq * w as q, nc * w as c, na * w as a from (select c.*, ln((n + 1)::double / (coalesce(df, 0) + 1)) as w from counts c left join seen using (term), texts)),
sums as (select sample_id, sum(c * a) as ca, sum(q * a) as qa, sqrt(sum(q * q)) as lq, sqrt(sum(c * c)) as lc, sqrt(sum(a * a)) as la from weighed group by sample_id),
cosines as (select x.sample_id, case when not regexp_matches(context, '{NB}') or coalesce(lc * la, 0) = 0 then 0.0::double else round_even(ca / (lc * la), 6) end as cosine_ctx_ans,
  case when coalesce(lq * la, 0) = 0 then 0.0::double else round_even(qa / (lq * la), 6) end as cosine_q_ans from split_qa x left join sums using (sample_id))
"""
UNIT = "(('0x' || substr({h}, {at}, 13))::bigint::double / 4503599627370496::double)".format


UNIFIED = f"""{RAW}, {TURNS},
asked as (select 'c_' || conv_id || '_' || turn as sample_id, conv_id, question, context, answer from turns where role = 'assistant'),
replies as (select doc_id, (1 - quality)::int as label from labels join documents using (doc_id)),
flags as (select doc_id, (1 - quality > 0 or toxic > 0)::int as label from labels),
judged as (select doc_id, label, case when label = 1 or doc_id % 11 = 0 then 'hallucinated' else 'grounded' end as said, doc_id % 9 + 1 as c, doc_id % 4 as style from replies),
said as (select *, '{{"judgment": "' || said || '", "confidence": 0.' || c || '}}' as body from judged),
unified as (select 'qa' as source, sample_id, item_idx::varchar as source_group_id, 'qa' as task, 'general' as domain, question, context, answer, label, 'unknown' as generator from qa
  union all select 'responses', 'response_' || printf('%08d', doc_id), printf('%08d', doc_id), case when doc_id % 3 = 2 then 'summary' else 'qa' end, coalesce(lang, 'general'), '', coalesce(source, ''), coalesce(text, ''), f.label, 'unknown' from documents left join flags f using (doc_id)
  union all select 'turns', sample_id, conv_id::varchar, 'chat', 'general', question, context, coalesce(answer, ''), null, 'unknown' from asked
  union all select 'judge', 'judge_' || doc_id, doc_id::varchar, 'other', 'general', '', '', case style when 0 then body when 1 then '```json' || chr(10) || body || chr(10) || '```' when 2 then 'Verdict: ' || body || ' done' else 'It is ' || said end, label, 'judge' from said)
"""
NEWTON_ROUNDS = 12
NEWTON = "".join(
    f""",
      e{i} as (select c.g, x, c.n * (y - 1 / (1 + exp(-(a + b * x)))) as r, c.n * (1 / (1 + exp(-(a + b * x)))) * (1 - 1 / (1 + exp(-(a + b * x)))) as h from cells c join f{i} f on c.g is not distinct from f.g),
      s{i} as (select g, sum(r) as g0, sum(r * x) as g1, sum(h) as h0, sum(h * x) as h1, sum(h * x * x) as h2 from e{i} group by g),
      f{i + 1} as (select f.g, f.n, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b from f{i} f join s{i} s on f.g is not distinct from s.g)"""
    for i in range(NEWTON_ROUNDS)
)


def swapped(kind: str, pattern: str) -> str:
    return f"""select sample_id, '{kind}' as kind, answer from (with {RAW},
      occ as (select sample_id, unnest(regexp_extract_all(answer, '{pattern}')) as v, unnest(range(len(regexp_extract_all(answer, '{pattern}')))) as place from qa),
      ranked as (select *, row_number() over (order by md5('42:' || v) || md5('42:' || sample_id || ':' || place)) - 1 as r, count(*) over () as n from occ),
      moved as (select a.sample_id, list(b.v order by a.place) as vs from ranked a, (select max(c) as m from (select count(*) as c from occ group by v)) join ranked b on b.r = (a.r + m) % a.n group by a.sample_id)
      select q.sample_id, case when vs is null then answer else array_to_string(list_transform(list_zip(string_split_regex(answer, '{pattern}'), vs), lambda x: x[1] || coalesce(x[2], '')), '') end as answer from qa q left join moved using (sample_id))"""


SQL: dict[str, str] = {
    "c10_gazetteer": f"""with recursive {RAW},
      names as (select distinct name from (select unnest({ent('text')}) as name from (select text from benchmark union all select question from qa))),
      told as (select name, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+') as ts from names),
      phrases as (select array_to_string(ts, ' ') as phrase, len(ts) as n, min(name) as name from told where len(ts) between 1 and 4 group by all),
      texts as (select sample_id, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+') as ts from qa),
      places as (select sample_id, ts, unnest(range(len(ts))) as pos from texts),
      spans as (select sample_id, pos, n, array_to_string(list_slice(ts, pos + 1, pos + n), ' ') as phrase from places, (select distinct n from phrases) where pos + n <= len(ts)),
      best as (select sample_id, pos, max(struct_pack(n := n, name := name)) as m from spans join phrases using (phrase, n) group by sample_id, pos),
      each as (select sample_id, pos, m.n as n, m.name as name from best),
      next as (select a.sample_id, a.pos, a.n, a.name, min(b.pos) as follows from each a left join each b on b.sample_id = a.sample_id and b.pos >= a.pos + a.n group by all),
      walk as (select * from next x where pos = (select min(pos) from next y where y.sample_id = x.sample_id) union all select n.* from walk w join next n on n.sample_id = w.sample_id and n.pos = w.follows)
      select sample_id, pos as "at", n::int as n, name from walk""",
    "z2_unified_schema": f"""with {UNIFIED} select source, sample_id, source_group_id, task, domain, length(question) as question_chars, length(context) as context_chars, length(answer) as answer_chars, label, 0 as n_spans, generator from unified""",
    "z2_mapping_report": f"""with {UNIFIED}, columns(source, col, mapped, dropped) as (
      select 'qa', c, count(*), 0 from qa, (select unnest(['sample_id', 'source_group_id', 'task', 'question', 'context', 'answer', 'label']) as c) group by c
      union all select 'qa', c, 0, 0 from (select unnest(['domain', 'spans', 'generator']) as c)
      union all select 'responses', c, count(*), 0 from documents, (select unnest(['sample_id', 'source_group_id', 'task']) as c) group by c
      union all select 'responses', 'domain', count(lang), 0 from documents union all select 'responses', 'context', count(source), 0 from documents union all select 'responses', 'answer', count(text), 0 from documents
      union all select 'responses', 'label', count(l.doc_id), 0 from documents join labels l using (doc_id)
      union all select 'responses', c, 0, 0 from (select unnest(['question', 'spans', 'generator']) as c)
      union all select 'turns', c, count(*), 0 from asked, (select unnest(['sample_id', 'source_group_id', 'task', 'question', 'context']) as c) group by c
      union all select 'turns', 'answer', count(answer), 0 from asked union all select 'turns', c, 0, 0 from (select unnest(['domain', 'label', 'spans', 'generator']) as c)
      union all select 'judge', c, count(*), 0 from replies, (select unnest(['sample_id', 'source_group_id', 'answer', 'label', 'generator']) as c) group by c
      union all select 'judge', c, 0, 0 from (select unnest(['task', 'domain', 'question', 'context', 'spans']) as c)
      union all select 'judge', c, 0, count(*) from replies, (select unnest(['in_tokens', 'out_tokens', 'latency_ms']) as c) group by c),
      totals as (select 'qa' as source, count(*) as n from qa union all select 'responses', count(*) from documents union all select 'turns', count(*) from asked union all select 'judge', count(*) from replies)
      select source, col as "column", mapped, case when dropped > 0 or col in ('in_tokens', 'out_tokens', 'latency_ms') then 0 else n - mapped end as defaulted, dropped from columns join totals using (source)""",
    "z3_recalibration": f"""with x as (select l_linestatus || ':' || round(l_discount * 100)::int as g, (l_returnflag = 'R')::int::double as y, least(1 - 1e-6::double, greatest(1e-6::double, l_quantity / 50)) as p from lineitem),
      cells as (select g, ln(p / (1 - p)) as x, y, count(*) as n from x group by all union all select null, ln(p / (1 - p)), y, count(*) from x group by all),
      f0 as (select g, sum(n) as n, 0.0::double as a, 0.0::double as b from cells group by g){NEWTON}
      select f.g as subgroup, f.n::bigint as n, f.n < 40 as pooled, round(case when f.n < 40 then p.a else f.a end, 6) as intercept, round(case when f.n < 40 then p.b else f.b end, 6) as slope from f{NEWTON_ROUNDS} f, f{NEWTON_ROUNDS} p where f.g is not null and p.g is null""",
    "z6_swaps": " union all ".join(swapped(kind, pattern) for kind, pattern in (("numbers", r"\b\d+(?:\.\d+)?%?\b"), ("names", NAME))),
    "e2_missing_scores": f"with {RAW} select sample_id, item_idx from qa where regexp_matches(context, '{NB}') and item_idx not in (select vec_id from embeddings)",
    "d8_tfidf_cosines": f"with {TERMS} select * from cosines",
    "k3_bootstrap": f"""with {PRED},
      cells as (select *, concat_ws(':', 777, {SCORE_KEY}, label, pred, rep) as own from (select prob as score, label, pred, count(*) as n from pred group by all), (select unnest(range(1, 1001)) as rep)),
      hashed as (select rep, score, label, pred, n, i, md5(own || ':' || i) as h from cells, (select unnest(range(1, {TRIES + 1})) as i)),
      units as (select *, {UNIT(h='h', at=1)} as u, {UNIT(h='h', at=14)} as v from hashed),
      small as (select rep, score, label, pred, sum({poisson_one_sql('u')}) as w from units where n < {LARGE} and i <= n group by all),
      large as (select rep, score, label, pred, coalesce(arg_min(k, i), any_value(n)) as w from (select *, {poisson_trial_sql('n::double', 'u', 'v')} as k from units where n >= {LARGE}) group by rep, score, label, pred),
      drawn as (select * from small union all select * from large),
      per as (select rep, score, coalesce(sum(w) filter (label = 1), 0) as pos, coalesce(sum(w) filter (label = 0), 0) as neg from drawn group by all),
      ranked as (select *, coalesce(sum(pos) over (partition by rep order by score desc rows between unbounded preceding and 1 preceding), 0) as before, sum(pos) over (partition by rep) as ap, sum(neg) over (partition by rep) as an from per),
      auroc as (select rep, sum(neg * (before + pos / 2)) / any_value(ap * an) as auroc from ranked where ap > 0 and an > 0 group by rep),
      f1 as (select rep, 2 * coalesce(sum(w) filter (label = 1 and pred = 1), 0) / (2 * coalesce(sum(w) filter (label = 1 and pred = 1), 0) + coalesce(sum(w) filter (label <> pred), 0)) as f1 from drawn group by rep),
      each as (select 'f1' as metric, f1 as value from auroc join f1 using (rep) union all select 'auroc', auroc from auroc)
      select metric, round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high from each group by metric""",
    "a3_source_choice": f"with {RAW}, n as (select count(*) as rows from qa), f(source, feature) as (values "
    + ", ".join(f"('{source}', '{f}')" for source, gone in (("full", ""), ("core", "entity")) for g in GROUPS if g not in ("nli", "semantic", gone) for f in GROUPS[g]) + ") select source, feature, rows from f, n",
    "a4_cached_table": f"with {RAW} select label, count(*) as n from qa group by label",
    "b4_line_numbers": "select row_number() over (order by item_id) - 1 as item_idx, item_id, length(text) as n_chars from benchmark",
    "b7_feature_columns": f"with {FEATURES} select sample_id, {LENGTH}, {LEXICAL}, {ENTITIES}, {NUMERIC} from features",
    "h1_best_threshold": f"""with {FEATURES}, groups as (select item_idx, max(label) as stratum from qa group by item_idx),
      ranked as (select *, row_number() over (partition by stratum order by md5('42:' || item_idx), item_idx) as rank, count(*) over (partition by stratum) as total from groups),
      rows as (select f.*, case when 100 * rank <= 70 * total then 'train' when 100 * rank <= 85 * total then 'val' else 'test' end as split from features f join ranked using (item_idx)),
      t as (select i, case when i = 100 then 1.0::double else i * 0.01::double end as threshold from range(101) r(i)),
      s as (select threshold, sum((overlap_answer_context < threshold and label = 1)::int) as tp, sum((overlap_answer_context < threshold)::int) as pp, sum(label) as p from t, rows where split = 'val' group by threshold),
      best as (select threshold from s order by coalesce(2.0::double * tp / nullif(pp + p, 0), 0) desc, threshold limit 1),
      pred as (select label, (overlap_answer_context < threshold)::int as pred from rows, best where split = 'test'), c as ({CONFUSION} from pred) select {POINT}, threshold from c, best""",
    "h2_scaled": f"""with {NLI_QA}, groups as (select item_idx, max(label) as stratum from qa group by item_idx),
      ranked as (select *, row_number() over (partition by stratum order by md5('42:' || item_idx), item_idx) as rank, count(*) over (partition by stratum) as total from groups),
      train as (select n.* from nli_qa n join ranked using (item_idx) where 100 * rank <= 70 * total) """
    + " union all ".join(f"select '{f}' as feature, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std from (select coalesce({f}, {DEFAULTS[f]!r})::double as x from train)" for f in SCALED),
    "k2_mcnemar_by_group": f"""with r as (select l_linenumber, (l_returnflag = 'R')::int as label, (l_quantity >= 25)::int as pa, (l_discount * 10 >= 0.5)::int as pb from lineitem),
      m as (select l_linenumber, sum((pa = label and pb <> label)::int)::bigint as b, sum((pa <> label and pb = label)::int)::bigint as c from r where l_linenumber between 1 and 7 group by all) select l_linenumber, b, c, {mcnemar_p(MCNEMAR)} as p from m""",
    "k4_wilcoxon": """with d as (select avg(l_discount) - avg(l_tax) as d from lineitem group by l_linenumber), nz as (select d, row_number() over (order by abs(d)) - 1 as bit, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from d where d <> 0),
      w as (select count(*) as n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w from nz),
      sums as (select mask, sum(case when (mask >> bit) & 1 = 1 then r else 0 end) as s from (select unnest(range(0, (1 << n)::bigint)) as mask from w), nz group by mask)
      select any_value(n) as n, any_value(w)::double as w, least(1.0::double, 2.0::double * sum((s <= w + 1e-9)::int) / count(*)) as p from sums, w""",
    "l2_linear_importance": f"with {IMPACTS} select feature, round(avg(abs(impact)), 6) as importance from impacts group by feature order by 2 desc limit 3",
    "l3_linear_top": f"""with {IMPACTS}, r as (select *, row_number() over (partition by sample_id order by abs(round(impact, 6)) desc, feature) as rank from impacts), names(feature, name) as (values {', '.join(f"('{k}', '{v}')" for k, v in PLAIN_NAMES.items())})
      select sample_id, rank::int as rank, feature, coalesce(name, feature) as name, round_even(value, 6) as value, round(impact, 6) as impact from r left join names using (feature) where rank <= 2""",
    "n6_readiness": f"with {RAW} select {len(DEFAULTS)} as n_features, [{', '.join(repr(f) for f in DEFAULTS if f in GROUPS['nli'] + GROUPS['semantic'])}] as missing, false as ready, count(*) as rows from qa",
    "n7_stream": f"""with {TURNS}, asked as (select * from turns where role = 'assistant' and regexp_matches(answer, '{NB}') and length(question) <= 5000 and length(context) <= 20000 and length(answer) <= 20000),
      s as (select 'c_' || conv_id || '_' || turn as sample_id, {tok('answer')} as ta, {tok('context')} as tc from asked),
      p as (select sample_id, {CLAMP(p="1 - case when len(ta) = 0 then 0.0::double else len(list_intersect(ta, tc))::double / len(ta) end")} as p from s)
      select sample_id, round(p, 4) as risk_score, {LABELS(p='p')} as label from p""",
    "n7_stream_rejected": "with c as (select distinct conv_id from conversations), r(case_, reason) as (values ('null', 'answer missing'), ('blank', 'answer blank'), ('long', 'question too long'), ('context', 'context too long'), ('answer', 'answer too long')),"
      f"""{TURNS}, w as (select 'c_' || conv_id || '_' || turn as sample_id, case when answer is null then 'answer missing' when not regexp_matches(answer, '{NB}') then 'answer blank' when length(question) > 5000 then 'question too long'
        when length(context) > 20000 then 'context too long' when length(answer) > 20000 then 'answer too long' end as reason from turns where role = 'assistant')
      select case_ || '_' || conv_id as sample_id, reason from c, r union all select * from w where reason is not null""",
    "z6_perturbations": " union all ".join(perturbed(n, a) for n, a in (("none", "answer"), ("drop_sentence", r"regexp_replace(answer, '[^.!?]*[.!?]*\s*$', '')"), ("insert_sentence", "answer || ' This holds in every case.'"),
      ("change_numbers", "regexp_replace(answer, '[0-9]', '7', 'g')"), ("change_entities", r"regexp_replace(answer, '\p{Lu}[\p{L}\p{N}_]*', 'Other', 'g')"))),
    "a1_jsonl_scan": f"with {RAW} select count(*) as records, sum(length(question))::bigint as question_chars, sum(length(right_answer))::bigint as answer_chars, sum((hallucinated_answer is null)::int)::bigint as without from qa_raw",
    "a2_parquet_scan": "select l_returnflag, count(*) as n, round(sum(l_quantity), 6) as quantity from lineitem where l_shipdate >= timestamp '1995-01-01' group by all",
    "a5_sinks": f"with {SPLIT} select sink, split, label, count(*) as n, sum(item_idx)::bigint as ids, count(distinct sample_id) as samples from split_qa, (values ('parquet'), ('json'), ('csv')) s(sink) group by all",
    "a7_provenance": f"with {RAW}, {NLI} select 'embeddings' as source, 'contradiction,entailment,neutral' as class_order, 2 as directions, count(*) as samples, count(ctx_c) as scored from qa left join nli using (item_idx)",
    "b2_dropped": f"with {RAW} select (select count(*) from qa_raw) as records, (select count(*) from records) as kept",
    "e3_alignment": f"with {NLI_QA} select not regexp_matches(context, '{NB}') as blank, nli_ctx_entails_ans is not null as scored, count(*) as n from nli_qa group by all",
    "f6_error_sample": f"with {ERR} select sample_id, error_type from (select *, row_number() over (partition by error_type order by md5('42:' || sample_id), sample_id) as r from err) where r <= 10",
    "b1_fields": f"with {RAW} select item_idx, question, context, right_answer, hallucinated_answer from records",
    "b3_expand": f"with {RAW} select sample_id, item_idx, question, context, answer, label from qa",
    "b5_labelled": "select d.doc_id, quality as label from documents d join labels using (doc_id) where quality is not null",
    "b6_responses": """select 'ragtruth_' || lpad(d.doc_id::varchar, 8, '0') as sample_id, lang as question, source as context, text as answer,
      (coalesce(1 - quality, 0) > 0 or coalesce(toxic, 0) > 0)::int as label from documents d left join labels l using (doc_id) where d.doc_id % 3 <> 2""",
    "b8_split_filter": f"with {SPLIT} select sample_id, item_idx, label from split_qa where split = 'val'",
    "b9_projections": f"with {PRED} select sample_id, round({CLAMP(p='prob')}, 4) as risk_score, round({CLAMP(p='prob')}, 6) as clamped, sample_id[1:4] as short from pred",
    "b10_risk_label": f"with {PRED} select sample_id, {LABELS(p=CLAMP(p='prob'))} as label from pred",
    "b11_display_band": f"with {PRED}, p as (select sample_id, least(100, greatest(0, round(prob * 100))) as pct from pred) select sample_id, case when pct >= 70 then 'high' when pct >= 30 then 'medium' else 'low' end as band from p",
    "c_length_features": f"with {FEATURES} select sample_id, {LENGTH} from features",
    "c5_tokens": rf"select doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as n_tokens, len({tok('text')}) as n_distinct from documents",
    "c6_numbers": f"select doc_id, list_sort({num('text')}) as numbers from documents",
    "c7_hedging": f"with {FEATURES} select sample_id, {HEDGING} from features",
    "c9_blank_context": f"with {RAW} select sample_id, not regexp_matches(context, '{NB}') as blank_context from qa",
    "c10_entities": f"select doc_id, list_sort({ent('text')}) as entities from documents",
    "c11_judge_parse": f"""with {REPLY} select doc_id, said as judgment, case when style = 3 then 0.5 else conf end as confidence, style <> 3 as parsed from verdicts""",
    "c12_plain_names": "with names(feature, name) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in PLAIN_NAMES.items()) + "), f as (select distinct event_type as feature from events union select feature from names) select f.feature, coalesce(name, f.feature) as name from f left join names using (feature)",
    "d1_lexical": f"with {FEATURES} select sample_id, {LEXICAL} from features",
    "d3_numeric": f"with {FEATURES} select sample_id, {NUMERIC} from features",
    "d5_entity": f"with {FEATURES} select sample_id, {ENTITIES} from features",
    "d7_cosine": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)
      select a.vec_id, case when b.vec_id is null then 0.0::double else round_even(list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))), 6) end as cosine
      from v a left join v b on b.vec_id = a.vec_id + 1""",
    "e1_attach_text": f"with {FEATURES} select sample_id, n_words, question, context, answer from features",
    "e2_attach_nli": f"with {NLI_QA} select sample_id, nli_ctx_entails_ans, nli_ctx_contradicts_ans, nli_ctx_neutral_ans, nli_ans_entails_ctx, nli_ans_contradicts_ctx, nli_ans_neutral_ctx from nli_qa",
    "e4_group_split": f"with {SPLIT} select sample_id, split from split_qa",
    "e5_core_features": f"with {FEATURES} select sample_id, item_idx, label, {LENGTH}, {LEXICAL}, {ENTITIES}, {NUMERIC}, {HEDGING} from features",
    "e6_pair_models": f"with {PRED} select sample_id, label, pred as pred_a, pred_b from pred",
    "f1_group_split": f"with {SPLIT} select item_idx, split from splits",
    "f1_lineitem_split": """with g as (select l_orderkey as item_idx, max((l_returnflag = 'R')::int) as stratum from lineitem group by l_orderkey),
      r as (select *, row_number() over (partition by stratum order by md5('42:' || item_idx), item_idx) as rank, count(*) over (partition by stratum) as total from g)
      select item_idx, case when 100 * rank <= 70 * total then 'train' when 100 * rank <= 85 * total then 'val' else 'test' end as split from r""",
    "f2_folds": f"with {SPLIT} select sample_id, ((rank - 1) % 5)::int as fold from qa join ranked using (item_idx)",
    "f4_sample": f"with {RAW} select sample_id, label from qa order by md5('42:' || sample_id), sample_id limit 50",
    "f5_balanced_sample": f"with {RAW} select sample_id, label from (select *, row_number() over (partition by label order by md5('42:' || sample_id), sample_id) as r from qa) where r <= 100",
    "f7_head": f"with {RAW} select sample_id, label from qa order by sample_id limit 20",
    "g1_label_balance": f"with {RAW} select label, count(*) as n from qa group by label",
    "g2_integrity": f"""with {SPLIT}, s as (select count(*) as n_groups, 0::bigint as spanning from groups)
      select split, count(distinct item_idx) as groups, count(*) as rows, round(avg(label), 4) as label_mean, n_groups, spanning, true as leakage_free from split_qa, s group by split, n_groups, spanning""",
    "g3_split_index": f"with {SPLIT} select distinct split, item_idx from split_qa",
    "g4_error_pivot": f"with {ERR} select error_type, " + ", ".join(f"sum((category = '{c}')::int)::bigint as {c}" for c in CATEGORIES) + " from err group by error_type",
    "g5_over_seeds": """with r as (select l_returnflag as model, l_linestatus as metric, l_linenumber as seed, round(sum(l_discount), 6) as value from lineitem group by all)
      select model, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, list(value order by seed) as values from r group by all""",
    "g6_manifest": " union all ".join(map(manifest_row, TABLES)),
    "g7_dashboard": f"""with {PRED}, models as (select 'boosted_trees' as model, label, pred as p from pred union all select 'heuristic', label, pred_b from pred),
      c as (select model, 2.0::double * sum((p = 1 and label = 1)::int) / (2 * sum((p = 1 and label = 1)::int) + sum((p <> label)::int)) as f1 from models group by model),
      d as (select sum((pred = label and pred_b <> label)::int)::bigint as b, sum((pred <> label and pred_b = label)::int)::bigint as c from pred)
      select model, round(f1, 6) as f1, f1 = max(f1) over () as is_best, round({COST_PER_1000['llm_judge']} / {COST_PER_1000['local']}, 6) as cost_ratio, d.b, d.c from c, d""",
    "g8_comparison": f"""with {PRED}, models as (select 'boosted_trees' as model, 4 as position, label, pred as p from pred union all select 'heuristic', 1, label, pred_b from pred)
      select model, position, 2.0::double * sum((p = 1 and label = 1)::int) / (2 * sum((p = 1 and label = 1)::int) + sum((p <> label)::int)) as f1 from models group by all""",
    "h1_threshold_sweep": f"""with {FEATURES}, t as (select i, case when i = 100 then 1.0::double else i * 0.01::double end as threshold from range(101) r(i)),
      s as (select threshold, sum((overlap_answer_context < threshold and label = 1)::int) as tp, sum((overlap_answer_context < threshold)::int) as pp, sum(label) as p from t, features group by threshold)
      select threshold, coalesce(2.0::double * tp / nullif(pp + p, 0), 0) as f1 from s""",
    "h6_class_weight": f"with {SPLIT}, t as (select sum((label = 0)::int)::double / sum((label = 1)::int) as w from qa) select sample_id, case when label = 1 then w else 1.0 end as weight from qa, t",
    "i1_point_metrics": f"with {PRED}, c as ({CONFUSION} from pred) select {POINT} from c",
    "i3_ranking": f"with {SCORES} select round(sum(neg * (bp + pos / 2.0::double)) / max(ap::double * an), 9) as auroc, round(sum(pos::double / ap * (bp + pos) / (bp + pos + bn + neg)), 9) as pr_auc from cum",
    "i5_ece": f"with {PRED}, b as (select {BIN} as bin, count(*) as n, avg(prob) as c, avg(label) as a from pred group by 1) select round(sum(n * abs(a - c)) / sum(n), 9) as ece from b",
    "i6_brier": f"with {PRED} select round(avg(pow(prob - label, 2)), 9) as brier from pred",
    "i7_reliability": f"with {PRED} select {BIN} as bin, count(*) as n, round(avg(prob), 9) as confidence, round(avg(label), 9) as accuracy from pred group by 1",
    "i8_curves": f"with {SCORES} select score, (bp + pos)::double / ap as tpr, (bn + neg)::double / an as fpr, (bp + pos)::double / (bp + pos + bn + neg) as precision, (bp + pos)::double / ap as recall from cum",
    "i9_agreement": f"with {PRED} select avg((pred = pred_b)::int) as agreement from pred",
    "k1_mcnemar_predictions": f"with {PRED}, m as (select sum((pred = 1 and pred_b = 0)::int)::bigint as b, sum((pred = 0 and pred_b = 1)::int)::bigint as c from pred) select b, c, {MCNEMAR} as statistic, {mcnemar_p(MCNEMAR)} as p from m",
    "k2_mcnemar_correctness": f"""with {PRED}, m as (select sum((pred = label and pred_b <> label)::int)::bigint as b, sum((pred <> label and pred_b = label)::int)::bigint as c, sum((pred = label and pred_b = label)::int)::bigint as both_right,
      sum((pred <> label and pred_b <> label)::int)::bigint as neither from pred) select b, c, both_right, neither, {MCNEMAR} as statistic, {mcnemar_p(MCNEMAR)} as p from m""",
    "k6_judge_report": f"""with {REPLY}, v as (select *, (said = 'hallucinated')::int as pj, (conf >= 0.5)::int as pm from verdicts),
      c as (select count(*) as n, {', '.join(f"sum((p{x} = 1 and label = 1)::int)::double as tp_{x}, sum((p{x} = 1)::int)::double as pp_{x}, sum((p{x} = label)::int)::double as ok_{x}" for x in 'jm')}, sum(label)::double as pos,
        avg((pj = pm)::int) as agreement, sum((pj = label and pm <> label)::int)::bigint as judge_only_right, sum((pj <> label and pm = label)::int)::bigint as model_only_right,
        sum(in_tokens)::bigint as in_tokens, sum(out_tokens)::bigint as out_tokens, quantile_cont(latency_ms, 0.5) as p50, quantile_cont(latency_ms, 0.95) as p95 from v),
      d as (select *, in_tokens / 1e6 * 0.2 + out_tokens / 1e6 * 1.2 as usd from c)
      select {', '.join(f"round(ok_{x} / n, 6) as {name}_accuracy, round(coalesce(tp_{x} / nullif(pp_{x}, 0), 0), 6) as {name}_precision, round(coalesce(tp_{x} / nullif(pos, 0), 0), 6) as {name}_recall, round(coalesce(2 * tp_{x} / nullif(pp_{x} + pos, 0), 0), 6) as {name}_f1" for x, name in (('j', 'judge'), ('m', 'model')))},
        round(agreement, 6) as agreement, n, judge_only_right, model_only_right, in_tokens, out_tokens, round(usd, 9) as cost_usd, round(usd / n * 1000, 9) as cost_per_1000_usd, round(p50, 6) as latency_p50, round(p95, 6) as latency_p95 from d""",
    "l1_linear": f"with {IMPACTS} select sample_id, feature, value, round(impact, 6) as impact from impacts",
    "l4_three_cases": f"""with {PRED} select 'high' as "case", (select sample_id from pred order by prob desc, sample_id limit 1) as sample_id, (select max(prob) from pred) as prob
      union all select 'low', (select sample_id from pred order by prob, sample_id limit 1), (select min(prob) from pred)
      union all select 'borderline', (select sample_id from pred order by abs(prob - 0.5), sample_id limit 1), (select prob from pred order by abs(prob - 0.5), sample_id limit 1)""",
    "m1_errors": f"with {ERR} select sample_id, error_type, category from err",
    "m3_cases": f"""with {ERR}, r as (select *, row_number() over (partition by error_type order by md5('42:' || sample_id), sample_id) as r from err)
      select sample_id, error_type, label as true_label, pred as predicted_label, round_even(prob, 4) as probability, category, question[1:300] as question, context[1:400] as context, answer[1:300] as answer,
      n_words::double as n_words, round_even(overlap_answer_context, 4) as overlap, round_even(coalesce(nli_ctx_entails_ans, 0), 4) as entails from r where r <= 10""",
    "m4_summary": f"with {ERR} select count(*) as n, sum((error_type = 'false_positive')::int)::bigint as n_false_positive, sum((error_type = 'false_negative')::int)::bigint as n_false_negative from err",
    "m5_defaults": f"with {FEATURES} select sample_id, n_words, 1.0::double / 3 as nli_ctx_neutral_ans, 0.0::double as cosine_q_ans, n_sentences from features",
    "m6_latency": """with q as (select event_type as component, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.95), 2) as p95, round(avg(value), 2) as mean from events where value is not null group by 1),
      t as (select user_id, sum(value) as s from events group by 1) select * from q union all select 'total', round(quantile_cont(s, 0.5), 2), null, null from t""",
    "m7_cost": f"with {RAW} select w as way, (select count(*) from qa) as rows, (select count(*) from qa) / 1000.0::double * u as cost_usd from (values " + ", ".join(f"('{w}', {c}::double)" for w, c in COST_PER_1000.items()) + ") v(w, u)",
    "n1_validation": f"""select 'c_' || conv_id || '_' || turn as sample_id, case when text is null then 'answer missing' when not regexp_matches(text, '{NB}') then 'answer blank' when length(text) > 20000 then 'answer too long' end as reason from conversations where role = 'assistant'""",
    "n4_judge_jobs": f"with {REPLY} select doc_id, case when style = 3 then 'failed' else said end as judgment, case when style = 3 then null else conf end as confidence from verdicts",
    "z2_unified": f"with {RAW} select sample_id, 'qa' as task, label from qa union all select 'ragtruth_' || lpad(d.doc_id::varchar, 8, '0'), 'response', (coalesce(1 - quality, 0) > 0 or coalesce(toxic, 0) > 0)::int from documents d left join labels l using (doc_id) where d.doc_id % 3 <> 2",
    "z3_subgroup_calibration": f"""with g as (select (l_returnflag = 'R')::int as label, l_quantity / 50 as prob, l_linestatus || ':' || round(l_discount * 100)::int as subgroup from lineitem),
      x as (select *, {BIN} as bin, least(1 - 1e-6::double, greatest(1e-6::double, prob)) as q from g union all select label, prob, null, {BIN}, least(1 - 1e-6::double, greatest(1e-6::double, prob)) from g),
      b as (select subgroup, bin, count(*) as n, avg(prob) as c, avg(label) as a from x group by all), e as (select subgroup, sum(n * abs(a - c)) / sum(n) as ece from b group by all),
      r as (select subgroup, count(*) as n, avg(pow(prob - label, 2)) as brier, avg(-ln(case when label = 1 then q else 1 - q end)) as nll from x group by all),
      f as (select r.*, e.ece from r join e on r.subgroup is not distinct from e.subgroup), pool as (select * from f where subgroup is null),
      w as (select subgroup from f where subgroup is not null and n >= 40 order by ece desc, subgroup limit 1)
      select f.subgroup, f.n, f.n < 40 as pooled, round(case when f.n < 40 then pool.ece else f.ece end, 9) as ece, round(case when f.n < 40 then pool.brier else f.brier end, 9) as brier, round(case when f.n < 40 then pool.nll else f.nll end, 9) as nll,
        coalesce(f.subgroup = (select subgroup from w), false) as worst from f, pool where f.subgroup is not null""",
    "z4_length_metrics": f"""with {NLI_QA}, c as (select least(4, n_words // 10) as bucket, count(*) as n, sum((pred = label)::int)::double as ok from risk group by 1), a as (select *, ok / n as accuracy, 1.959963984540054::double as z from c)
      select bucket, n, accuracy, round((accuracy + z * z / (2 * n) - z * sqrt(accuracy * (1 - accuracy) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) as low,
        round((accuracy + z * z / (2 * n) + z * sqrt(accuracy * (1 - accuracy) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) as high from a""",
    "z4_bootstrap_intervals": f"""with {NLI_QA}, cells as (select least(4, n_words // 10) as bucket, (pred = label)::int as ok, count(*) as n from risk group by all),
      hashed as (select bucket, ok, rep, n, i, md5(concat_ws(':', 777, bucket, ok, rep) || ':' || i) as h from cells, (select unnest(range(1, 1001)) as rep), (select unnest(range(1, {TRIES + 1})) as i)),
      units as (select *, {UNIT(h='h', at=1)} as u, {UNIT(h='h', at=14)} as v from hashed),
      drawn as (select bucket, ok, rep, sum({poisson_one_sql('u')}) as w from units where n < {LARGE} and i <= n group by all
        union all select bucket, ok, rep, coalesce(arg_min(k, i), any_value(n)) from (select *, {poisson_trial_sql('n::double', 'u', 'v')} as k from units where n >= {LARGE}) group by bucket, ok, rep),
      each as (select bucket, rep, sum(w * ok) / sum(w) as value from drawn group by bucket, rep having sum(w) > 0),
      ends as (select bucket, round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high from each group by bucket),
      shares as (select bucket, round(sum(n * ok) / sum(n), 9) as share from cells group by bucket) select bucket, share, low, high from shares join ends using (bucket)""",
    "z7_dedup": f"with {RAW} select min(sample_id) as sample_id, count(*) as copies from qa group by lower(regexp_replace(answer, '[{SP}]+', ' ', 'g'))",
}
SQL["entry"] = f"with {FEATURES}, r as (select label, {LABELS(p=CLAMP(p='1 - overlap_answer_context'))} as risk, overlap_answer_context as o from features) select label, risk, count(*) as n, round(avg(1 - o), 6) as mean_risk from r group by all"
