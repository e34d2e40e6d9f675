"""Golden sets, claim rules on drafts with planted faults, review checklists and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from litsieve import sinks
from litsieve.operators import claims, evaluation
from litsieve.sources import records
from litsieve.sources.adapters import table, view

from .base import query
from .retrieval import KEY

# Drafts of nine claims, each with its own fault by doc_id % 9, and a last line without a mark. Every tenth document's claim is labelled as supported.
FAULTS = [
    ("supported", "", None), ("unsupported", "numbers", "numbers"), ("unsupported", "existence", "existence"), ("contradicted", "direction", "direction"), ("overclaim", "overclaim", "overclaim"),
    ("unverifiable", "no_source_text", "no_source_text"), ("unverifiable", "cross_lingual", "cross_lingual"), ("unsupported", "grounding", "grounding"), ("weakly_supported", "script_independent_only", None),
]
WORDS = "concat('measured outcome ', trim(regexp_replace(substr(coalesce(text, ''), 1, 120), '[^A-Za-z]+', ' ')))"


def planted(spark, d):
    """(draft_id, k, line, source_text) for each document."""
    words = table(spark, d, "documents").select((F.col("doc_id") / 9).cast("long").alias("draft_id"), (F.col("doc_id") % 9).cast("int").alias("k"), F.expr(WORDS).alias("w"))
    k, w = F.col("k"), F.col("w")
    tail = F.when(k == 1, " 87.31%").when(k.isin(3, 4), " proves it").otherwise("")
    line = F.concat(w, tail, F.lit(" ["), F.when(k == 2, 99).otherwise(k + 1).cast("string"), F.lit("]."))
    source = (
        F.when(k == 3, F.concat(F.lit("no significant difference "), w)).when(k == 4, F.concat(F.lit("pilot study "), w)).when(k == 5, " ")
        .when(k == 6, "研究方案中文来源内容").when(k == 7, "wholly different vocabulary").when(k == 8, F.concat(w, F.lit(" 研究内容来源"))).otherwise(w)
    )
    return words.select("draft_id", "k", line.alias("line"), source.alias("source_text"))


def planted_claims(spark, d):
    rows = planted(spark, d)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    drafts = rows.groupBy("draft_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\nplain words only")).alias("draft"))
    return drafts, claims.claims(drafts), rows.select("draft_id", (F.col("k") + 1).alias("cite_id"), "source_text")


def planted_check(spark, d):
    drafts, found, sources = planted_claims(spark, d)
    return drafts, claims.check(found, sources)


def judged(spark, d):
    _, found, sources = planted_claims(spark, d)
    number = F.col("citations")[0]
    k = F.when(number == 99, 2).otherwise(number - 1)
    gold = F.element_at(F.array(*(F.lit(v) for v, _, _ in FAULTS)), k + 1)
    rule = F.element_at(F.array(*(F.lit(r) for _, _, r in FAULTS)), k + 1)
    cases = found.withColumns({"gold": F.when((F.col("draft_id") * 9 + k) % 10 == 0, "supported").otherwise(gold), "expected_rule": rule})
    return evaluation.judged_cases(cases, sources)


EXPECTED = """told as (select doc_id, doc_id // 9 as draft_id, doc_id % 9 as k, row_number() over (partition by doc_id // 9 order by doc_id) - 1 as line,
      case when doc_id % 9 = 0 then 'supported' when doc_id % 9 in (1, 2, 7) then 'unsupported' when doc_id % 9 = 3 then 'contradicted' when doc_id % 9 = 4 then 'overclaim' when doc_id % 9 in (5, 6) then 'unverifiable' else 'weakly_supported' end as verdict,
      case doc_id % 9 when 0 then '' when 1 then 'numbers' when 2 then 'existence+cross_lingual' when 3 then 'direction' when 4 then 'overclaim' when 5 then 'no_source_text' when 6 then 'cross_lingual' when 7 then 'grounding' else 'script_independent_only' end as rules
    from documents),
    labelled as (select *, case when doc_id % 10 = 0 then 'supported' else verdict end as gold, verdict in ('unsupported', 'overclaim', 'contradicted') as p from told)"""


@query("clm_05_10_planted", f"with {EXPECTED} select draft_id, line, verdict, rules from told")
def _(spark, d):
    _, checked = planted_check(spark, d)
    return checked.select("draft_id", F.split("claim_id", ":")[1].cast("long").alias("line"), "verdict", F.array_join("rules", "+").alias("rules"))


@query("clm_15_planted", f"with {EXPECTED}, r as (select draft_id, concat(draft_id, ':', line, ':0') as claim_id, verdict, row_number() over (partition by draft_id order by case when verdict = 'overclaim' then 1 else 0 end, line) as n from labelled where p) select * from r where n <= 6")
def _(spark, d):
    _, checked = planted_check(spark, d)
    return claims.issues(checked).select("draft_id", "claim_id", "verdict", F.col("n").cast("long").alias("n"))


COUNTS = ", ".join(f"count(*) filter (verdict = '{v}') as {v}" for v in ("supported", "weakly_supported", "unverifiable", "unsupported", "overclaim", "contradicted"))


@query("agg_19_planted_report", f"with {EXPECTED} select draft_id, count(*) as claims, {COUNTS}, round(count(*) filter (verdict = 'supported') / count(*), 4) as supported_rate, round(count(*) / (count(*) + 1), 4) as coverage from told group by 1")
def _(spark, d):
    drafts, checked = planted_check(spark, d)
    return claims.report(checked, claims.coverage(drafts))


@query("agg_19_rule_counts", f"with {EXPECTED}, e as (select draft_id, unnest(string_split(rules, '+')) as rule from told where rules <> ''), n as (select draft_id, rule, count(*) as n from e group by all) select t.draft_id, coalesce(string_agg(rule || '=' || n, ',' order by rule), '') as by_rule from (select distinct draft_id from told) t left join n using (draft_id) group by 1")
def _(spark, d):
    _, checked = planted_check(spark, d)
    entries = F.transform(F.map_entries("by_rule"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return claims.rule_counts(checked).select("draft_id", F.array_join(entries, ",").alias("by_rule"))


@query(
    "agg_18_per_class",
    f"""with {EXPECTED}, v(verdict) as (values ('supported'), ('weakly_supported'), ('unverifiable'), ('unsupported'), ('overclaim'), ('contradicted')),
    c as (select v.verdict, count(*) filter (l.gold = v.verdict) as support, count(*) filter (l.verdict = v.verdict) as predicted, count(*) filter (l.gold = v.verdict and l.verdict = v.verdict) as hits from v, labelled l group by 1)
    select *, round(case when predicted > 0 then hits / predicted else 0 end, 4) as precision, round(case when support > 0 then hits / support else 0 end, 4) as recall from c""",
)
def _(spark, d):
    return evaluation.per_class(judged(spark, d))


@query(
    "agg_18_binary",
    f"""with {EXPECTED}, g as (select *, gold in ('unsupported', 'overclaim', 'contradicted') as q from labelled),
    c as (select count(*) filter (q and p) as tp, count(*) filter (not q and p) as fp, count(*) filter (not q and not p) as tn, count(*) filter (q and not p) as fn, count(*) as total, count(*) filter (gold = verdict) as verdict_match,
      count(*) filter (k not in (0, 8)) as rule_total, count(*) filter (k not in (0, 8)) as rule_hit from g)
    select *, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round((tp + tn) / total, 4) as accuracy, round(rule_hit / rule_total, 4) as rule_hit_rate from c""",
)
def _(spark, d):
    return evaluation.binary(judged(spark, d))


@query("agg_18_failures", f"with {EXPECTED} select concat(draft_id, ':', line, ':0') as claim_id, gold, verdict as predicted, gold = 'supported' as false_alarm from labelled where gold <> verdict")
def _(spark, d):
    return evaluation.failures(judged(spark, d)).select("claim_id", "gold", "predicted", "false_alarm")


# golden sets ----------------------------------------------------------------------------------------------------------
def golden_lines(spark, d):
    """A line per benchmark item in each of the shapes that occur, by item_id % 8; its labels are the documents item_id and item_id + 1."""
    item, kind = F.col("item_id").cast("string"), F.col("item_id") % 8
    following = (F.col("item_id") + 1).cast("string")
    grades = F.when(kind == 2, F.create_map(item, F.lit("2"), following, F.lit("high"), F.concat(F.lit("x"), item), F.lit("1"))).when(kind.isin(0, 5), F.create_map(item, F.lit("2"), following, F.lit("high")))
    base = [F.col("text").alias("query"), F.when(kind == 5, "robot").when(kind == 0, "manual").alias("source"), F.when(kind == 4, True).alias("expect_no_relevant")]
    listed = F.to_json(F.struct(*base, F.array(item, following, item).alias("relevant")))
    line = F.when(kind == 6, '{"query": " "}').when(kind == 7, "{oops").when(kind == 1, listed).otherwise(F.to_json(F.struct(*base, grades.alias("relevant"))))
    return table(spark, d, "benchmark").select("item_id", line.alias("value"))


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.substring("text", 1, 80).alias("title"))


LABELS = """g as (select item_id, text, item_id % 8 as kind from benchmark),
    l as (select item_id, kind, item_id::varchar as doc, case when kind = 1 then 1.0 else 2.0 end::double as gain from g where kind in (0, 1, 2, 5)
      union all select item_id, kind, (item_id + 1)::varchar, 1.0 from g where kind in (0, 1, 2, 5) union all select item_id, kind, 'x' || item_id, 1.0 from g where kind = 2)"""


@query("src_16_golden_labels", f"with {LABELS} select item_id, doc, gain from l")
def _(spark, d):
    return evaluation.qrels(evaluation.golden_cases(golden_lines(spark, d)), "item_id")


@query(
    "src_16_set_problems",
    f"""with {LABELS} select 'broken' as kind, item_id::varchar as at, '' as detail from g where kind in (6, 7)
    union all select 'no_labels', item_id::varchar, substr(trim(text), 1, 24) from g where kind = 3
    union all select 'unknown_docs', item_id::varchar, string_agg(doc, ',' order by doc) from l where doc not in (select doc_id::varchar from documents) group by 2
    union all select 'unknown_source', item_id::varchar, 'robot' from g where kind = 5
    union all select 'no_title', doc_id::varchar, '' from documents where trim(coalesce(substr(text, 1, 80), '')) = ''""",
)
def _(spark, d):
    return evaluation.set_problems(evaluation.golden_cases(golden_lines(spark, d)), corpus(spark, d), "item_id")


@query("snk_05_golden_again", f"with {LABELS} select md5(trim(text)) as query, count(doc) as labels, coalesce(sum(gain), 0)::double as gain, g.kind = 4 as declared from g left join l using (item_id) where g.kind not in (6, 7) group by item_id, text, g.kind")
def _(spark, d):
    """The cases written out as lines and read again."""
    cases = evaluation.golden_cases(golden_lines(spark, d)).where("not broken")
    again = evaluation.golden_cases(sinks.golden_lines(cases))
    total = F.aggregate(F.map_values("relevant"), F.lit(0.0), lambda a, x: a + x)
    return again.select(F.md5(F.col("query").cast("binary")).alias("query"), F.size("relevant").cast("long").alias("labels"), total.alias("gain"), F.col("expect_no_relevant").alias("declared"))


# reviews --------------------------------------------------------------------------------------------------------------
@query(
    "agg_11_checklist",
    """with r as (select query as review_id, sum(result_count) as identified from search_logs_v group by 1),
    c as (select unnest(string_split('1 2 3 4 5 6 7 8 9 10a 10b 11 12 13a 13b 13c 14 15 16a 16b 17 18 19 20a 20b 21 22 23a 23b 24a 24b 24c 25 26 27', ' ')) as code, generate_subscripts(string_split('1 2 3 4 5 6 7 8 9 10a 10b 11 12 13a 13b 13c 14 15 16a 16b 17 18 19 20a 20b 21 22 23a 23b 24a 24b 24c 25 26 27', ' '), 1) as n),
    done as (select distinct 'q' || (doc_id % 20) as review_id, doc_id % 41 + 1 as n from labels where quality = 0)
    select review_id, code, case when exists (select 1 from done where done.review_id = r.review_id and done.n = c.n) then 'done' when code in ('6', '7', '16a', '16b', '17', '24a') and identified > 0 then 'auto' else 'manual' end as status from r, c""",
    "search_logs_v",
)
def _(spark, d):
    reviews = view(spark, d, "search_logs_v").groupBy(F.col("query").alias("review_id")).agg(F.sum("result_count").alias("identified"))
    codes = F.array(*map(F.lit, evaluation.CHECKLIST))
    covered = table(spark, d, "labels").where("quality = 0").select(F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")).alias("review_id"), F.get(codes, (F.col("doc_id") % 41).cast("int")).alias("code"))
    return evaluation.checklist(reviews, covered)


ASSESSED = """select concat(source, '-', lang) as run_id, n_chars % 4 <> 0 as use_in_review, case n_chars % 5 when 0 then 'RCT' when 1 then '动物实验' when 2 then '其他' when 3 then 'Meta分析/系统评价' else '队列研究' end as evidence_level,
  case when n_chars % 3 = 0 then '样本量偏小（n=9）' when n_chars % 3 = 1 then '' end as limitation from documents"""


@query(
    "agg_14_gaps",
    f"""with a as ({ASSESSED}), m as (select run_id, count(*) filter (use_in_review) as usable, count(*) filter (use_in_review and evidence_level in ('RCT', 'Meta分析/系统评价')) as high, count(*) filter (use_in_review and evidence_level = '动物实验') as animal,
      count(*) filter (use_in_review and coalesce(limitation, '') like '样本量偏小%') as small, count(*) filter (use_in_review and evidence_level = '其他') as unclear from a group by 1)
    select *, concat_ws('+', case when usable = 0 then 'nothing_usable' end, case when usable > 0 and high = 0 then 'no_high_level' end, case when usable > 0 and high between 1 and 2 then 'few_high_level' end, case when usable between 1 and 4 then 'few_usable' end,
      case when usable > 0 and animal = usable then 'animals_only' end, case when small > 0 and small >= greatest(2, usable // 2) then 'small_samples' end, case when unclear > 0 and unclear >= usable // 2 then 'unclear_designs' end) as missing from m""",
)
def _(spark, d):
    documents = table(spark, d, "documents")
    assessed = spark.sql(ASSESSED.replace("from documents", "from {documents}"), documents=documents)
    return evaluation.gaps(assessed, "run_id").withColumn("missing", F.array_join("missing", "+"))


# searches over several sources: a query is a language, ranks are ids; src2 leads. Each source gives 60, a query returns 2 * 80.
ORDER = ["src2", "src0", "src1"]
FOUND = f"""r as (select language as query_id, *, row_number() over (partition by language, source order by paper_id) as n from papers_v),
    c as (select * exclude (ingest_seq), row_number() over (partition by query_id order by case source when 'src2' then 1 when 'src0' then 2 when 'src1' then 3 else 4 end, source, paper_id) as ingest_seq, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') as tk from r where n <= 60),
    m as (select query_id, dedup_key, min(ingest_seq) as first_seq, count(*) as merged, max(cited_by_count) as cited_by_count, arg_max(title, (length(title), -ingest_seq)) as title from (select *, {KEY} as dedup_key from c) group by 1, 2),
    s as (select *, row_number() over (partition by query_id order by first_seq) as place from m)"""


def found(spark, d):
    return view(spark, d, "papers_v").withColumns({"query_id": F.col("language"), "rank": F.col("paper_id")})


@query("src_17_merged", f"with {FOUND} select query_id, place, merged, cited_by_count, md5(title) as title from s where place <= 160", "papers_v")
def _(spark, d):
    made = records.merged_search(found(spark, d), ORDER, 60, 80)
    return made.select("query_id", F.col("place").cast("long").alias("place"), "merged", "cited_by_count", F.md5(F.col("title").cast("binary")).alias("title"))


@query(
    "src_17_status",
    f"""with {FOUND}, q as (select distinct language as query_id from papers_v), o as (select unnest(['src2', 'src0', 'src1', 'gone']) as source),
    f as (select query_id, source, count(*) as found from c group by all), a as (select query_id, count(*) as raw_count from c group by 1), b as (select query_id, count(*) as merged_count from s where place <= 160 group by 1)
    select query_id, source, source <> 'gone' as ok, coalesce(found, 0) as found, case when source = 'gone' then 'HTTP 503' end as error, coalesce(raw_count, 0) as raw_count, coalesce(merged_count, 0) as merged_count
    from q cross join o left join f using (query_id, source) left join a using (query_id) left join b using (query_id)""",
    "papers_v",
)
def _(spark, d):
    rows = found(spark, d)
    queries = rows.select("query_id").distinct()
    errors = queries.select("query_id", F.lit("gone").alias("source"), F.lit("HTTP 503").alias("error"))
    return records.search_status(queries, rows, errors, [*ORDER, "gone"], 60, 80)
