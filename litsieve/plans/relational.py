"""Filters, projections, joins, aggregates, windows, sorts and set operations over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from litsieve.functions import rules, text
from litsieve.operators import analytics, filters, library, windows
from litsieve.sources.adapters import table, view

from .base import query

P = "paper_id, pub_year, cited_by_count"


@query("flt_01_metadata", f"select {P} from papers_v where pub_year >= 2000 and pub_year <= 2015 and journal ilike '%j-e%' and cited_by_count >= 50 and is_open_access and trim(abstract) <> '' and source in ('src1', 'src2', 'src3')", "papers_v")
def _(spark, d):
    return filters.metadata(view(spark, d, "papers_v"), year_from=2000, year_to=2015, journal="j-e", min_cited=50, open_access=True, has_abstract=True, sources=["src1", "src2", "src3"]).select("paper_id", "pub_year", "cited_by_count")


@query("flt_02_bulk_match", f"select {P} from papers_v where contains(lower(title || ' ' || abstract), 'the') and contains(lower(title || ' ' || abstract), 'tion') and (pub_year is null or pub_year >= 2005) and trim(abstract) <> ''", "papers_v")
def _(spark, d):
    return filters.bulk(view(spark, d, "papers_v"), terms=["the", "TION"], year_from=2005, require_abstract=True).select("paper_id", "pub_year", "cited_by_count")


@query("flt_03_relevant", "select paper_id from (select paper_id, lower(title || ' ' || abstract) as h from papers_v) where contains(h, 'erre')::int + contains(h, 'thion')::int + contains(h, 'heit')::int >= 2", "papers_v")
def _(spark, d):
    return filters.relevant(view(spark, d, "papers_v"), ["of", "erre", "thion", "heit"]).select("paper_id")


@query("flt_04_boolean", "select paper_id from (select paper_id, lower(title || ' ' || abstract) as h from papers_v) where contains(h, 'the') and contains(h, 'of the') and (contains(h, 'ing') or contains(h, 'tion')) and not contains(h, 'une')", "papers_v")
def _(spark, d):
    return filters.boolean_match(view(spark, d, "papers_v"), must=["the"], any_groups=[["ing", "tion"]], exclude=["une"], phrases=["of the"]).select("paper_id")


@query("flt_06_log_window", "select id, query, source from search_logs_v where created_at >= (select min(ts) + interval 10 day from events) and query in ('q1', 'q2', 'q7')", "search_logs_v")
def _(spark, d):
    logs = view(spark, d, "search_logs_v")
    since = table(spark, d, "events").agg((F.min("ts") + F.expr("interval 10 days")).alias("t")).first()["t"]
    return filters.log_window(logs, since=since, queries=["q1", "q2", "q7"]).select("id", "query", "source")


@query("flt_07_feedback_list", "select id, verdict, target_type from feedback_v where target_type = 'paper' and run_id = 'r3' order by id desc limit 50", "feedback_v")
def _(spark, d):
    return filters.feedback_list(view(spark, d, "feedback_v"), limit=50, target_type="paper", run_id="r3").select("id", "verdict", "target_type")


@query("flt_08_golden_candidates", f"select {P} from papers_v where pub_year >= 2000 and cited_by_count >= 10 and length(abstract) >= 1 order by cited_by_count desc, paper_id limit 60", "papers_v")
def _(spark, d):
    return filters.golden_candidates(view(spark, d, "papers_v"), 60, year_from=2000, min_cited=10).select("paper_id", "pub_year", "cited_by_count")


@query("flt_09_long_enough", "select paper_id from papers_v where length(abstract) >= 120", "papers_v")
def _(spark, d):
    return view(spark, d, "papers_v").where(F.char_length("abstract") >= 120).select("paper_id")


@query("prj_01_embed_text", "select paper_id, md5(title || chr(10) || 'MeSH: ' || array_to_string([source, language], ' ') || chr(10) || abstract) as digest from papers_v", "papers_v")
def _(spark, d):
    mesh = F.slice(F.array("source", "language"), 1, 12)
    whole = F.concat_ws("\n", "title", F.when(F.size(mesh) > 0, F.concat(F.lit("MeSH: "), F.concat_ws(" ", mesh))), "abstract")
    return view(spark, d, "papers_v").select("paper_id", F.md5(whole.cast("binary")).alias("digest"))


@query(
    "prj_02_citation_label",
    "select paper_id, array_to_string(w[1:3], ', ') || case when len(w) > 3 then ' et al.' else '' end as short_authors, coalesce(w[1], '') || ' ' || pub_year as label from (select paper_id, pub_year, string_split(title, ' ') as w from papers_v)",
    "papers_v",
)
def _(spark, d):
    words = F.split("title", " ")
    short = F.concat(F.array_join(F.slice(words, 1, 3), ", "), F.when(F.size(words) > 3, " et al.").otherwise(""))
    return view(spark, d, "papers_v").select("paper_id", short.alias("short_authors"), F.concat_ws(" ", words[0], F.col("pub_year").cast("string")).alias("label"))


@query(
    "prj_03_title_terms",
    "select paper_id, array_to_string(list_filter(string_split(trim(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) > 3)[1:6], ' ') as query from papers_v",
    "papers_v",
)
def _(spark, d):
    words = F.split(F.trim(F.regexp_replace("title", "[^\\p{L}\\p{N}]+", " ")), " ")
    return view(spark, d, "papers_v").select("paper_id", F.array_join(F.slice(F.filter(words, lambda w: F.char_length(w) > 3), 1, 6), " ").alias("query"))


@query("joi_01_references", "select c.citing_paper_id, c.cited_paper_id, c.cited_external_id, p.pub_year from citations_v c left join papers_v p on c.cited_paper_id = p.paper_id", "citations_v", "papers_v")
def _(spark, d):
    return library.references(view(spark, d, "citations_v"), view(spark, d, "papers_v")).select("citing_paper_id", "cited_paper_id", "cited_external_id", "pub_year")


@query("joi_02_citing_papers", "select cited_paper_id, citing_paper_id, p.pub_year from (select distinct cited_paper_id, citing_paper_id from citations_v where cited_paper_id is not null) c join papers_v p on c.citing_paper_id = p.paper_id", "citations_v", "papers_v")
def _(spark, d):
    return library.citing_papers(view(spark, d, "citations_v"), view(spark, d, "papers_v")).select("cited_paper_id", "citing_paper_id", "pub_year")


REFS = "select paper_id + 1 as citing_paper_id, case when paper_id % 2 = 0 then doi end as doi, case when paper_id % 3 = 0 then pmid end as pmid, title, source from papers_v"


@query(
    "joi_03_resolve_references",
    f"""with refs as ({REFS}), d as (select doi, min(paper_id) as id from papers_v where doi is not null group by 1), m as (select pmid, min(paper_id) as id from papers_v where pmid is not null group by 1)
    select distinct citing_paper_id, coalesce(d.id, m.id) as cited_paper_id, coalesce(r.doi, r.pmid, substr(title, 1, 400)) as cited_external_id, source
    from refs r left join d on r.doi = d.doi left join m on r.pmid = m.pmid""",
    "papers_v",
)
def _(spark, d):
    papers = view(spark, d, "papers_v")
    return library.resolve_references(spark.sql(REFS.replace("papers_v", "{p}"), p=papers), papers)


@query("joi_04_project_members", "select m.project_id, p.paper_id, p.pub_year from (select distinct * from project_papers_v) m join papers_v p using (paper_id)", "project_papers_v", "papers_v")
def _(spark, d):
    return library.project_members(view(spark, d, "papers_v"), view(spark, d, "project_papers_v")).select("project_id", "paper_id", "pub_year")


@query("joi_05_missing_embeddings", "select paper_id from papers_v where paper_id not in (select vec_id from embeddings)", "papers_v")
def _(spark, d):
    return library.missing(view(spark, d, "papers_v"), table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"))).select("paper_id")


@query(
    "joi_06_fulltext_candidates",
    "select paper_id, cited_by_count from papers_v where (is_open_access or pmcid is not null) and paper_id not in (select doc_id from labels where quality = 0) and paper_id not in (select doc_id from labels where toxic = 1) order by (pmcid is null), cited_by_count desc, paper_id limit 200",
    "papers_v",
)
def _(spark, d):
    labels = table(spark, d, "labels")
    done = labels.where("quality = 0").select(F.col("doc_id").alias("paper_id"))
    failed = labels.select(F.col("doc_id").alias("paper_id"), (F.col("toxic") == 1).alias("permanent"))
    return library.fulltext_candidates(view(spark, d, "papers_v"), done, failed, 200).select("paper_id", "cited_by_count")


@query("joi_07_runs_artifacts", "select run_id, status, artifact_id, a.title from agent_runs_v r left join (select paper_id as artifact_id, title from papers_v) a using (artifact_id) order by created_at desc, run_id desc limit 100", "agent_runs_v", "papers_v")
def _(spark, d):
    artifacts = view(spark, d, "papers_v").select(F.col("paper_id").alias("artifact_id"), "title")
    return library.runs_with_artifacts(view(spark, d, "agent_runs_v"), artifacts, 100).select("run_id", "status", "artifact_id", "title")


@query(
    "joi_08_find_ids",
    """with lib as (select *, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') as tk from papers_v where paper_id % 2 = 0),
    d as (select doi, min(paper_id) as id from lib where doi <> '' group by 1), m as (select pmid, min(paper_id) as id from lib where pmid <> '' group by 1), t as (select tk, min(paper_id) as id from lib where tk <> '' group by 1),
    inc as (select *, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') as tk from papers_v where paper_id % 2 = 1)
    select i.ingest_seq, coalesce(d.id, m.id, t.id) as paper_id from inc i left join d on i.doi = d.doi left join m on i.pmid = m.pmid left join t on i.tk = t.tk""",
    "papers_v",
)
def _(spark, d):
    papers = view(spark, d, "papers_v").withColumn("title_key", text.title_key(F.col("title")))
    return library.find_ids(papers.where("paper_id % 2 = 1").drop("paper_id"), papers.where("paper_id % 2 = 0")).select("ingest_seq", "paper_id")


@query("joi_15_apply_penalties", """with pen as (select cast(target_id as bigint) as paper_id, round(greatest(0.5, 1 - 0.1 * count(*)), 4) as factor from feedback_v where verdict = 'challenge' and corrected_text <> '' and category in ('fact', 'citation', 'overreach') and regexp_matches(target_id, '^\\d+$') group by 1),
    s as (select language as query_id, paper_id, round(cast(cited_by_count as double) * coalesce(factor, 1.0), 6) as score from papers_v left join pen using (paper_id))
    select *, row_number() over (partition by query_id order by score desc, paper_id) as rank from s""", "feedback_v", "papers_v")  # fmt: skip
def _(spark, d):
    hits = view(spark, d, "papers_v").select(F.col("language").alias("query_id"), "paper_id", F.col("cited_by_count").cast("double").alias("score"))
    return analytics.apply_penalties(hits, analytics.paper_penalty(view(spark, d, "feedback_v")))


@query("joi_19_child_counts", "select p.id, p.name, (select count(*) from project_papers_v m where m.project_id = p.id) as papers from projects_v p", "projects_v", "project_papers_v")
def _(spark, d):
    return library.with_counts(view(spark, d, "projects_v"), view(spark, d, "project_papers_v"), "id", "project_id", "papers").select("id", "name", "papers")


COST = "case when contains(model, ':') then 0.0 when model like 'deepseek-chat%' then (prompt_tokens * 2.0 + completion_tokens * 8.0) / 1e6 when model like 'deepseek-reasoner%' then (prompt_tokens * 4.0 + completion_tokens * 16.0) / 1e6 when model like 'gpt-4o-mini%' then (prompt_tokens * 1.0 + completion_tokens * 4.0) / 1e6 else 0.0 end"


@query("joi_20_price_prefix", f"select id, model, round(cast({COST} as double), 6) as cost from llm_usage_v", "llm_usage_v")
def _(spark, d):
    return analytics.with_cost(view(spark, d, "llm_usage_v")).select("id", "model", "cost")


@query("agg_01_search_logs", "select source, cast(sum(result_count) as bigint) as results, cast(sum(new_count) as bigint) as new_results, count(error) as failed, count(*) as searches, count(distinct query) as queries from search_logs_v group by rollup(source)", "search_logs_v")
def _(spark, d):
    return analytics.search_log_summary(view(spark, d, "search_logs_v"))


@query("agg_02_feedback", "select verdict, category, count(*) as n from feedback_v group by cube(verdict, category)", "feedback_v")
def _(spark, d):
    return analytics.feedback_summary(view(spark, d, "feedback_v"))


@query(
    "agg_03_usage",
    f"""with u as (select *, round(cast({COST} as double), 6) as cost from llm_usage_v)
    select model, phase, error_kind, count(*) as calls, count(*) filter (ok) as ok_calls, count(*) filter (not ok) as failed_calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, round(sum(cost), 4) as cost,
    round(quantile_cont(latency_ms, 0.5), 4) as p50, round(quantile_cont(latency_ms, 0.95), 4) as p95, count(distinct model) as models
    from u group by grouping sets ((), (model), (phase), (error_kind)) having grouping(error_kind) = 1 or error_kind is not null""",
    "llm_usage_v",
)
def _(spark, d):
    return analytics.usage_summary(analytics.with_cost(view(spark, d, "llm_usage_v")))


@query("agg_04_spans", "select event_type as name, count(*) as n, round(sum(value), 3) as total_ms, round(max(value), 3) as max_ms, count(*) filter (event_type = 'error') as errors from events group by 1")
def _(spark, d):
    span = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), F.lit(1).alias("depth"))
    traces = table(spark, d, "events").groupBy(F.concat_ws("-", "user_id", F.date_trunc("hour", "ts")).alias("trace_id")).agg(F.collect_list(span).alias("spans"))
    return analytics.span_summary(analytics.span_rows(traces))


@query("agg_05_stats", "select count(*) as papers, count(*) filter (abstract <> '') as with_abstract, min(pub_year) as min_year, max(pub_year) as max_year, (select count(distinct vec_id) from embeddings) as embedded, round((select count(distinct vec_id) from embeddings) / count(*), 4) as coverage from papers_v", "papers_v")
def _(spark, d):
    return analytics.library_stats(view(spark, d, "papers_v"), table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id")))


@query("agg_06_count_papers", "select m.project_id, count(*) as n from (select distinct * from project_papers_v) m join papers_v p using (paper_id) where pub_year >= 2010 group by 1", "project_papers_v", "papers_v")
def _(spark, d):
    kept = filters.metadata(library.project_members(view(spark, d, "papers_v"), view(spark, d, "project_papers_v")), year_from=2010)
    return kept.groupBy("project_id").agg(F.count("*").alias("n"))


@query("agg_07_failures", "select case error when 'HTTP 503' then '对方服务端错误（5xx，可重试）' when 'read timed out' then '网络超时/连接失败（可重试）' when 'HTTP 405' then '链接是落地页而非 PDF（405）' else '其他原因' end as label, error = 'HTTP 405' as permanent, count(*) as n, arg_min(error, id) as example from search_logs_v where error is not null group by 1, 2", "search_logs_v")
def _(spark, d):
    failed = view(spark, d, "search_logs_v").where("error is not null").withColumn("c", rules.classify_fulltext_error(F.col("error")))
    return analytics.failure_stats(failed.select(F.col("id").alias("seq"), "c.label", "c.permanent", F.col("error").alias("example")))


@query("agg_08_paper_penalty", "select cast(target_id as bigint) as paper_id, count(*) as n, round(greatest(0.5, 1 - 0.1 * count(*)), 4) as factor from feedback_v where verdict = 'challenge' and corrected_text <> '' and category in ('fact', 'citation', 'overreach') and regexp_matches(target_id, '^\\d+$') group by 1", "feedback_v")
def _(spark, d):
    return analytics.paper_penalty(view(spark, d, "feedback_v")).withColumn("factor", F.col("factor").cast("double"))


@query("agg_09_source_penalty", "select lower(trim(target_id)) as source, count(*) as n, round(greatest(0.5, count(*) filter (verdict = 'up') / count(*)), 4) as factor from feedback_v where target_type = 'search_result' group by 1 having count(*) >= 5 and count(*) filter (verdict = 'up') / count(*) < 0.9", "feedback_v")
def _(spark, d):
    return analytics.source_penalty(view(spark, d, "feedback_v"), min_ratio=0.9)


@query("agg_12_corrections", "select id, topic, topic = 't2' as same_topic from (select * from feedback_v where verdict = 'challenge' and corrected_text <> '' order by id desc limit 40) order by same_topic desc, id desc limit 10", "feedback_v")
def _(spark, d):
    return analytics.correction_memories(view(spark, d, "feedback_v"), "t2", 10).select("id", "topic", "same_topic")


@query("agg_13_preference_pairs", "select id, '[' || category || '] ' || topic as prompt, corrected_text as chosen, quoted_text as rejected from feedback_v where trim(corrected_text) <> '' and trim(quoted_text) <> ''", "feedback_v")
def _(spark, d):
    return analytics.preference_pairs(view(spark, d, "feedback_v")).drop("meta")


@query("agg_23_outcomes", """with e as (select query, source, sum(result_count) as found, max(error) as error from search_logs_v group by 1, 2)
    select query, count(*) as sources, count(*) filter (error is null) as ok, cast(sum(found) as bigint) as raw_count, case when count(error) = 0 then '{}' else '{' || string_agg('"' || source || '":"' || error || '"', ',' order by source) filter (error is not null) || '}' end as errors from e group by 1""".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"), "search_logs_v")  # fmt: skip
def _(spark, d):
    return analytics.outcome_report(view(spark, d, "search_logs_v"))


@query("win_01_ranks", "select language, paper_id, row_number() over (partition by language order by cited_by_count desc, paper_id) as rank from papers_v", "papers_v")
def _(spark, d):
    return windows.ranked(view(spark, d, "papers_v"), ["language"], [F.col("cited_by_count").desc(), "paper_id"]).select("language", "paper_id", "rank")


@query("win_02_top_k", "select source, paper_id, rank from (select source, paper_id, row_number() over (partition by source order by cited_by_count desc, paper_id) as rank from papers_v) where rank <= 3", "papers_v")
def _(spark, d):
    return windows.top(view(spark, d, "papers_v"), ["source"], [F.col("cited_by_count").desc(), "paper_id"], 3).select("source", "paper_id", "rank")


@query("win_04_renumber", "select run_id, idx, row_number() over (partition by run_id order by idx) as number from (select source as run_id, paper_id as idx, row_number() over (partition by source order by cited_by_count desc, paper_id) as r from papers_v) where r <= 12", "papers_v")
def _(spark, d):
    entries = view(spark, d, "papers_v").select(F.col("source").alias("run_id"), F.col("paper_id").alias("idx"), F.col("cited_by_count").alias("combined"))
    return windows.renumber(entries, 12).select("run_id", "idx", "number")


@query("win_05_retention", "select id from search_logs_v where created_at >= (select max(ts) - interval 2 day from events) order by id desc limit 200", "search_logs_v")
def _(spark, d):
    cutoff = table(spark, d, "events").agg((F.max("ts") - F.expr("interval 2 days")).alias("t")).first()["t"]
    return windows.keep_recent(view(spark, d, "search_logs_v"), cutoff, 200).select("id")


@query("win_06_latest_run", "select session_id, arg_max(run_id, (created_at, run_id)) as run_id, arg_max(status, (created_at, run_id)) as status from agent_runs_v group by 1", "agent_runs_v")
def _(spark, d):
    return windows.latest(view(spark, d, "agent_runs_v"), "session_id", ["created_at", "run_id"]).select("session_id", "run_id", "status")


@query("win_07_phases", "select cast(user_id as varchar) as run_id, array_to_string(list(distinct event_type order by case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end, event_type), ',') as phases from events group by 1")
def _(spark, d):
    steps = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("phase"))
    return windows.phases_of(steps, ["view", "click", "purchase"]).withColumn("phases", F.array_join("phases", ","))


@query("win_08_first_seen", "select regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') as key, min(ingest_seq) as first_seq from papers_v group by 1", "papers_v")
def _(spark, d):
    return view(spark, d, "papers_v").groupBy(text.title_key(F.col("title")).alias("key")).agg(F.min("ingest_seq").alias("first_seq"))


@query("win_09_key_suffix", "select paper_id, case when m > 1 then substr('abcdefghij', n, 1) else '' end as suffix from (select paper_id, row_number() over (partition by k order by paper_id) as n, count(*) over (partition by k) as m from (select paper_id, split_part(title, ' ', 1) || pub_year as k from papers_v))", "papers_v")
def _(spark, d):
    keyed = view(spark, d, "papers_v").withColumn("key", F.concat(F.substring_index("title", " ", 1), F.col("pub_year").cast("string")))
    return windows.key_suffix(keyed, "key", "paper_id").select("paper_id", "suffix")


LADDER = [(24, 1200), (16, 800), (12, 500), (8, 300)]
LADDER_SQL = ", ".join(f"sum(case when r <= {n} then cast(floor(least(length(abstract), {c}) / 3.5) as bigint) + 1 end) as t{i}" for i, (n, c) in enumerate(LADDER))


@query("win_10_fit_digest", f"""with r as (select source, abstract, row_number() over (partition by source order by cited_by_count desc, paper_id) as r from papers_v), t as (select source as run_id, {LADDER_SQL} from r group by 1)
    select run_id, case when t0 <= 3000 then 0 when t1 <= 3000 then 1 when t2 <= 3000 then 2 else 3 end as step, cast(case when t0 <= 3000 then t0 when t1 <= 3000 then t1 when t2 <= 3000 then t2 else t3 end as bigint) as tokens from t""", "papers_v")  # fmt: skip
def _(spark, d):
    papers = windows.ranked(view(spark, d, "papers_v"), ["source"], [F.col("cited_by_count").desc(), "paper_id"]).select(F.col("source").alias("run_id"), "rank", F.col("abstract").alias("text"))
    return windows.fit_digest(papers, 3000, LADDER)


@query("srt_01_list_papers", "select paper_id, pub_year, true as has_more from papers_v order by pub_year desc nulls last, paper_id limit 20 offset 40", "papers_v")
def _(spark, d):
    return library.list_papers(view(spark, d, "papers_v"), [F.col("pub_year").desc_nulls_last(), F.col("paper_id")], 20, 40).select("paper_id", "pub_year", "has_more")


@query("srt_02_newest", "select id, query, created_at from search_logs_v order by created_at desc, id desc limit 50", "search_logs_v")
def _(spark, d):
    return view(spark, d, "search_logs_v").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50).select("id", "query", "created_at")


@query("srt_04_judging_pool", "select paper_id, cited_by_count from papers_v order by cited_by_count desc, paper_id limit 12", "papers_v")
def _(spark, d):
    return view(spark, d, "papers_v").orderBy(F.col("cited_by_count").desc(), "paper_id").limit(12).orderBy("paper_id").select("paper_id", "cited_by_count")


@query("sca_03_doi", "select paper_id, 'https://doi.org/' || upper(doi) || '.' as raw, doi as doi from papers_v where doi is not null", "papers_v")
def _(spark, d):
    raw = F.concat(F.lit("https://doi.org/"), F.upper("doi"), F.lit("."))
    return view(spark, d, "papers_v").where("doi is not null").select("paper_id", raw.alias("raw"), text.normalize_doi(raw).alias("doi"))


@query("sca_04_fingerprint", "select paper_id, case when k = '' then '' else substr(sha1(k), 1, 16) end as fingerprint from (select paper_id, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') as k from papers_v)", "papers_v")
def _(spark, d):
    return view(spark, d, "papers_v").select("paper_id", text.title_fingerprint(F.col("title")).alias("fingerprint"))


@query("sca_02_clean_html", "select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]{1,80}>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&apos;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g'))) as digest from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.clean_abstract(F.col("html"), compose=False).cast("binary")).alias("digest"))


@query("sca_12_tokens", "select doc_id, case when text = '' then 0 else cast(floor(length(text) / 3.5) as int) + 1 end as tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("sca_13_truncate", "select doc_id, case when length(text) <= 100 then text else substr(text, 1, 99) || '…' end as short from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 100).alias("short"))


@query("sca_14_failures", "select id, case coalesce(error, '') when '' then '' when 'HTTP 429' then 'rate_limited' when 'read timed out' then 'timeout' when 'HTTP 503' then 'server_error' when 'connection reset' then 'connection' when 'HTTP 404' then 'not_found' when 'HTTP 401' then 'auth' when 'maximum context exceeded' then 'context_overflow' when 'HTTP 422' then 'bad_request' when 'json decode error' then 'parse' when 'request cancelled' then 'cancelled' else 'unknown' end as kind from search_logs_v", "search_logs_v")
def _(spark, d):
    return view(spark, d, "search_logs_v").select("id", rules.classify_failure(F.col("error")).alias("kind"))


@query("sca_20_combined", "select doc_id, round(0.6 * (doc_id % 11) + 0.4 * (n_chars % 11), 2) as combined from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(0.6 * (F.col("doc_id") % 11) + 0.4 * (F.col("n_chars") % 11), 2).alias("combined"))


@query("set_02_ordered_union", "select source, array_to_string(list(journal order by s), '|') as journals from (select source, lower(journal) as journal, min(ingest_seq) as s from papers_v group by 1, 2) group by 1", "papers_v")
def _(spark, d):
    held = view(spark, d, "papers_v").groupBy("source", F.lower("journal").alias("journal")).agg(F.min("ingest_seq").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("s", "journal")))
    return held.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["journal"]), "|").alias("journals"))
