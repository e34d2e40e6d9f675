"""Phrase search by query forms over a positional index."""

from __future__ import annotations

from pyspark.sql import functions as F

from litsieve.functions.text import CJK
from litsieve.operators import lexical
from litsieve.sources.adapters import table, view

from .base import query
from .retrieval import FIELDS, FULL, LEXICAL, RANKED, TOKENS

# TOKENS of text in which Chinese, Japanese and Korean signs stand apart.
APART = TOKENS.replace("lower({})", "lower(regexp_replace({}, '([" + CJK.replace("{", "{{").replace("}", "}}") + "])', ' \\1 ', 'g'))")
SPACED = "trim(regexp_replace(regexp_replace(query, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"
ASKED = "select item_id as query_id, text as query from benchmark union all select -1 - paper_id, title from mixed_papers_v where paper_id % 100 = 0"
POSITIONS = " union all ".join(f"select id, '{f}' as field, {w} as w, unnest(t) as term, unnest(range(len(t))) as pos from (select paper_id as id, {APART.format(f)} as t from mixed_papers_v)" for f, w in FIELDS.items())
FORMS = f"""with queries_ as ({ASKED}),
pos as materialized ({POSITIONS}),
sizes as (select id, count(*) as size from pos group by id), st as (select count(*) as n, avg(size) as m from sizes),
runs as (select query_id, regexp_extract_all({SPACED}, '[{CJK}](?:\\s*[{CJK}])*|[^\\s{CJK}]+') as r from queries_),
phrase as (select query_id, list_filter(list_transform(r, lambda x: array_to_string({APART.format("trim(x, chr(34))")}, ' ')), lambda u: u <> '') as units from runs),
bigram as (select query_id, list_filter(flatten(list_transform(r, lambda x: case when regexp_matches(x, '^[{CJK}].*[{CJK}]$')
    then list_distinct(list_transform(range(1, length(replace(x, ' ', ''))), lambda i: replace(x, ' ', '')[i] || ' ' || replace(x, ' ', '')[i + 1]))
    else [array_to_string({APART.format("trim(x, chr(34))")}, ' ')] end)), lambda u: u <> '') as units from runs),
asked as (
  select query_id, 'phrase' as form, units, len(list_distinct(units)) as needs from phrase
  union all select query_id, 'bigram', b.units, len(list_distinct(b.units)) from bigram b join phrase p using (query_id) where b.units <> p.units
  union all select query_id, 'or', b.units, 0 from bigram b join phrase p using (query_id) where len(b.units) > 1 or b.units <> p.units),
wanted as (select query_id, form, needs, unit, count(*) as times from (select query_id, form, needs, unnest(units) as unit from asked) group by all)
"""
SCORED = f"""{FORMS},
terms as (select unit, unnest(t) as term, unnest(range(len(t))) as place, len(t) as n from (select distinct unit, string_split(unit, ' ') as t from wanted)),
begins as (select unit, id, field, w, pos - place as start from terms join pos using (term) group by unit, id, field, w, pos - place, n having count(*) = n),
hits as (select unit, id, sum(w) as wtf from begins group by 1, 2), held as (select unit, count(*) as held from hits group by 1),
each as (
  select query_id, form, id, needs, count(*) as met,
    round(sum(times * greatest(1e-6, ln((n - held + 0.5) / (held + 0.5))) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * size / m))), 6) as score
  from wanted join held using (unit) join hits using (unit) join sizes using (id), st group by 1, 2, 3, 4),
cut as (select * from (select *, row_number() over (partition by query_id, form order by score desc, id) as place from each where met >= needs) where place <= 20),
best as (select query_id, id, max(score) as score, string_agg(distinct form, '+' order by form) as forms from cut group by 1, 2)
select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank, forms from best) where rank <= 20
"""


def asked(spark, d):
    titles = view(spark, d, "mixed_papers_v").where("paper_id % 100 = 0").select((-1 - F.col("paper_id")).alias("query_id"), F.col("title").alias("query"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).unionByName(titles)


@query("sca_11_query_forms", FORMS + " select query_id, form, cast(needs as int) as needs, unit, times from wanted", "mixed_papers_v")
def _(spark, d):
    return lexical.forms(asked(spark, d))


@query("set_01_query_forms_search", SCORED, "mixed_papers_v")
def _(spark, d):
    index = lexical.build(view(spark, d, "mixed_papers_v"), "paper_id", FIELDS)
    return lexical.search(index, asked(spark, d), 20)


def pruned(spark, docs, key, weights, queries, k):
    """OR form over an index written once, with the postings below the k-th score unread."""
    index = lexical.build(docs, key, weights, positions=False)
    units = queries.select("query_id", F.explode(F.array_distinct(lexical.word_tokens(F.col("query")))).alias("unit"))
    hits, bounds = lexical.hits_of(index, units.select("unit").distinct())
    held = bounds.groupBy("unit").agg(F.sum("held").alias("held"))
    wanted = units.join(held.hint("merge"), "unit").withColumn("w", lexical.idf(index, F.col("held")))
    return lexical.top_any(hits, bounds, wanted.select("query_id", "unit", "w"), k).select("query_id", "id", "score", "rank")


@query("ret_02_pruned", f"with {LEXICAL}, {RANKED} select query_id, id, score, rank from ranked where rank <= 10", "papers_v", "queries_v")
def _(spark, d):
    return pruned(spark, view(spark, d, "papers_v"), "paper_id", FIELDS, view(spark, d, "queries_v"), 10)


@query("ret_03_pruned", f"with {FULL}, {RANKED} select query_id, id, score, rank from ranked where rank <= 10", "queries_v")
def _(spark, d):
    return pruned(spark, table(spark, d, "documents"), "doc_id", {"text": 1.0}, view(spark, d, "queries_v"), 10)
