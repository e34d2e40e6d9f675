"""Finished drafts, artifacts, traces and bulk loads, over documents of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litsieve.functions import styles
from litsieve.functions import text as text_functions
from litsieve.operators import assessment, bulk, formatting, safety
from litsieve.operators.snapshots import Library
from litsieve.sources import artifacts
from litsieve.sources.adapters import table, view
from litsieve.store import folder

from .base import query

# drafts: sentences end in marks of several forms; lists of four entries a draft.
DRAFTS = """select doc_id as draft_id, case when doc_id % 5 = 0 then '## Intro' || chr(10) || '## Empty' || chr(10) || '  ' || chr(10) || '# Top' || chr(10) || '## Short' || chr(10) || 'few words' || chr(10) || '## Main' || chr(10) else '' end
    || replace(replace(replace(coalesce(text, ''), ', ', case when doc_id % 2 = 0 then ' [1, 3], ' else ' 【2，9】, ' end), '. ', case when doc_id % 3 = 0 then ' [2-4]. ' else ' [4]. ' end), '#', '') as draft,
    doc_id % 7 as kind from {documents}"""
ENTRIES = """select doc_id as draft_id, n as number, n as authors_, case when n = 4 then null else 1990 + doc_id % 30 + n end as pub_year, doc_id % 50 as who from {documents} cross join (values (1), (2), (3), (4)) as t(n) where n < 4 or doc_id % 4 = 0"""
LABEL = """case n.number when 1 then 'van der Berg' || who when 2 then 'Zhang' || who || ' & Li' when 3 then 'A' || who || ' et al.' else '佚名' end || ', ' || coalesce(cast(pub_year as varchar), 'n.d.')"""


def plain(sql):
    return sql.replace("{documents}", "documents")


@query(
    "clm_14_restyle",
    f"""with d as ({plain(DRAFTS)}), n as (select draft_id, number, {LABEL.replace('n.number', 'number')} as label from ({plain(ENTRIES)})),
    w as (select draft_id, draft, max(label) filter (number = 1) as l1, max(label) filter (number = 2) as l2, max(label) filter (number = 3) as l3, max(label) filter (number = 4) as l4 from d left join n using (draft_id) group by 1, 2)
    select draft_id, md5(replace(replace(replace(replace(draft, '[1, 3]', '(' || l1 || '; ' || l3 || ')'), '【2，9】', '(' || l2 || ')'), '[2-4]', ''), '[4]', case when l4 is null then '' else '(' || l4 || ')' end)) as draft from w""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    drafts = spark.sql(DRAFTS.replace("||", " || "), documents=docs).drop("kind")
    names = F.when(F.col("number") == 1, F.array(F.concat(F.lit("van der Berg"), "who", F.lit(" Jan")))).when(F.col("number") == 2, F.array(F.concat(F.lit("Zhang"), "who", F.lit(" Wei")), F.lit("Li Na"))).when(F.col("number") == 3, F.array(F.concat(F.lit("A"), "who", F.lit(" B")), F.lit("C"), F.lit("D")))
    entries = spark.sql(ENTRIES, documents=docs).select("draft_id", "number", names.alias("authors"), "pub_year")
    return formatting.restyle_inline(drafts, entries, "apa").select("draft_id", F.md5(F.col("draft").cast("binary")).alias("draft"))


@query(
    "clm_13_selfcheck",
    f"""with d as (select *, regexp_replace(draft, '^# [^\\n]*\\n|(\\n)# [^\\n]*', '', 'g') as body from ({plain(DRAFTS)})),
    c as (select draft_id, contains(draft, '[1, 3]') as a, contains(draft, '【2，9】') as b, contains(draft, '[2-4]') as r, contains(draft, '[4]') as f, draft from d)
    select draft_id, array_to_string(list_filter([case when b then 9 end], lambda x: x is not null), ',') as missing,
      array_to_string(list_filter([case when not a then 1 end, case when not b and not r then 2 end, case when not a and not r then 3 end, case when not r and not f then 4 end], lambda x: x is not null), ',') as never_cited,
      case when draft_id % 5 = 0 then 'Intro;Empty' || case when regexp_replace(split_part(draft, '## Main', 2), '\\s', '', 'g') = '' then ';Main' else '' end else '' end as empty_sections,
      case when draft_id % 5 = 0 then 'Short' || case when length(trim(split_part(draft, '## Main' || chr(10), 2), ' ' || chr(10))) between 1 and 59 then ';Main' else '' end else '' end as short_sections,
      case when b then 'revise' else 'pass' end as verdict, length(draft) as char_count from c""",
)
def _(spark, d):
    drafts = spark.sql(DRAFTS, documents=table(spark, d, "documents")).withColumn("valid", F.expr("array(1, 2, 3, 4)"))
    made = formatting.selfcheck(drafts)
    joined = [F.array_join(c, s).alias(c) for c, s in (("missing", ","), ("never_cited", ","), ("empty_sections", ";"), ("short_sections", ";"))]
    return made.select("draft_id", *joined, "verdict", "char_count")


@query(
    "joi_22_artifact_sources",
    """with a as (select conv_id as artifact_id, count(*) as n from conversations group by 1), r as (select artifact_id, unnest(range(1, n + 1)) as cite_id from a where artifact_id % 10 <> 9),
    p as (select artifact_id, cite_id, (artifact_id * 7 + cite_id) % 1200 as paper_id from r),
    s as (select p.*, case when p.paper_id % 3 = 0 then trim(coalesce(f.abstract, ''), ' ') else '' end as full_, trim(coalesce(f.abstract, ''), ' ') as abstract, f.title, f.journal, f.pub_year from p left join papers_v f on p.paper_id = f.paper_id)
    select artifact_id, cast(cite_id as int) as cite_id, md5(case when full_ = '' then abstract else 'full ' || full_ end) as source_text, case when full_ = '' then title end as title, case when full_ = '' then journal end as journal,
      case when full_ = '' then pub_year end as pub_year from s""",
    "papers_v",
)
def _(spark, d):
    talks = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("artifact_id")).agg(F.count("*").alias("n"))
    refs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.alias("index"), F.pmod(F.col("artifact_id") * 7 + i, F.lit(1200)).alias("paper_id")))
    odd = F.array(F.struct(F.lit("x").alias("index"), F.lit(1).alias("paper_id")))
    meta = F.when(F.col("artifact_id") % 10 == 9, "{broken").otherwise(F.concat(F.lit('{"references": ['), F.array_join(F.transform(odd, lambda x: F.to_json(x)), ","), F.lit(","), F.array_join(F.transform(refs, lambda x: F.to_json(x)), ","), F.lit("]}")))
    papers = view(spark, d, "papers_v").withColumn("publication_type", F.lit(""))
    fulltext = papers.where("paper_id % 3 = 0").select("paper_id", F.when(F.trim("abstract") != "", F.concat(F.lit("full "), F.trim("abstract"))).otherwise("").alias("text"))
    made = artifacts.artifact_sources(talks.select("artifact_id", meta.alias("meta")), papers, fulltext)
    return made.select("artifact_id", "cite_id", F.md5(F.col("source_text").cast("binary")).alias("source_text"), "title", "journal", "pub_year")


@query(
    "snk_06_traces",
    """select 't' || user_id as trace_id, name, count(*) as n, round(sum(round(ms, 3)), 3) as total_ms, round(max(round(ms, 3)), 3) as max_ms, count(*) filter (status = 'error') as errors from (
      select user_id, 'run' as name, 0.5 as ms, 'ok' as status from events group by user_id
      union all select user_id, event_type, value, case when event_type = 'error' then 'error' else 'ok' end from events
      union all select user_id, 'deep', 1.0, 'ok' from events where event_id % 2 = 0 union all select user_id, 'deeper', 2.0, 'error' from events where event_id % 4 = 0) group by 1, 2""",
)
def _(spark, d):
    leaf = """'{"name":"deep","status":"ok","duration_ms":1.0,"children":[' || if(event_id % 4 = 0, '{"name":"deeper","status":"error","duration_ms":2.0,"error":"x","children":[]}', '') || ']}'"""
    span = f"""'{{"name":"' || event_type || '","status":"' || if(event_type = 'error', 'error', 'ok') || '","duration_ms":' || cast(value as string) || ',"children":[' || if(event_id % 2 = 0, {leaf}, '') || ']}}'"""
    rows = table(spark, d, "events").selectExpr("user_id", f"{span} as span").groupBy("user_id").agg(F.array_join(F.collect_list("span"), ",").alias("spans"))
    traces = rows.selectExpr("""'{"trace_id":"t' || user_id || '","root":{"name":"run","status":"ok","duration_ms":0.5,"children":[' || spans || ']}}' as value""")
    path = f"{folder(spark)}/litsieve-traces/{uuid.uuid4().hex}"
    artifacts.append_traces(spark, traces, path)
    return artifacts.span_summary(artifacts.spans(spark.read.text(path)))


PAPER = "paper_id long, title string, abstract string, pub_year int, cited_by_count int, is_open_access boolean, pmid string, doi string, journal string, language string"


@query(
    "agg_20_bulk_report",
    """with m as (select * from papers_v where contains(lower(title || ' ' || abstract), 'the') and pub_year >= 2000)
    select (select count(*) from papers_v) as seen, count(*) as matched, count(*) filter (paper_id % 2 = 0) as with_fulltext, count(*) as created_and_merged from m""",
    "papers_v",
)
def _(spark, d):
    papers = view(spark, d, "papers_v").select("*", F.expr("array()").cast("array<string>").alias("mesh_terms"), F.expr("array()").cast("array<string>").alias("keywords"), F.expr("if(paper_id % 2 = 0, 'text', '')").alias("fulltext"))
    library = Library(spark, f"{folder(spark)}/litsieve-library/{uuid.uuid4().hex}", PAPER)
    made = bulk.load(papers, library, terms="the", year_from=2000)
    return spark.createDataFrame([(made["seen"], made["matched"], made["with_fulltext"], made["created"] + made["merged"])], "seen long, matched long, with_fulltext long, created_and_merged long")


@query("snk_07_keyed_library")
def _(spark, d):
    """The papers in two batches; no SQL: the merge rule is tested against whole upserts."""
    papers = view(spark, d, "papers_v")
    library = Library(spark, f"{folder(spark)}/litsieve-library/{uuid.uuid4().hex}", PAPER, bucket_rows=1_000)
    for part in (0, 1):
        library.apply(papers.where(F.col("paper_id") % 2 == part))
    return library.read()


# bibliographies: four kinds of author lists, with and without volume, issue, pages, DOI and journal.
STYLES = ["apa7", "vancouver", "gb7714", "chicago", "bibtex", "ris"]
HELD = """h as (select doc_id as n, doc_id % 4 as k, case when doc_id % 9 = 0 then 'n.d.' else cast(1990 + doc_id % 30 as varchar) end as y, case when doc_id % 6 = 0 then '（期刊信息缺失）' else 'J & ' || lang end as j, 'The {T} of ' || source || ' ' || doc_id % 3 as t,
    case when doc_id % 5 = 0 then '' else cast(doc_id % 80 as varchar) || case when doc_id % 2 = 0 then '(' || doc_id % 12 || ')' else '' end end as vi, case when doc_id % 7 = 0 then '' else doc_id || '-' || (doc_id + 9) end as p, case when doc_id % 3 = 0 then '' else '10.1/' || doc_id end as d,
    ['[J]', '[D]', '[C]', '[M]', '[EB/OL]'][1 + doc_id % 5] as mark, doc_id % 5 as g, case when doc_id % 5 = 0 then '' else cast(doc_id % 80 as varchar) end as v, case when doc_id % 2 = 0 then cast(doc_id % 12 as varchar) else '' end as i, lang, doc_id % 9 = 0 as nd from documents)"""
MANY = {"apa7": "array_to_string(list_transform(range(1, 20), lambda i: 'A' || i || ', B. C.'), ', ') || ', …, & A20, B. C.'", "vancouver": "array_to_string(list_transform(range(1, 7), lambda i: 'A' || i || ' BC'), ', ') || ', et al.'"}
APA = f"case k when 0 then 'Anonymous' when 1 then 'Zhang, W.' when 2 then 'van der Berg Jan, P., & 王伟' else {MANY['apa7']} end"
BIBLIOGRAPHY = f"""with {HELD}, s as (
  select n, 'apa7' as style, {APA} || ' (' || y || '). ' || t || '. ' || j || case when vi = '' then '' else ', ' || vi end || case when p = '' then '' else ', ' || p end || '.' || case when d = '' then '' else ' https://doi.org/' || d end as text from h
  union all select n, 'chicago', rtrim({APA}, '.') || '. ' || y || '. “' || t || '.” ' || j || case when vi = '' then '' else ' ' || vi end || case when p = '' then '' else ': ' || p end || '.' || case when d = '' then '' else ' https://doi.org/' || d end from h
  union all select n, 'vancouver', n || '. ' || case k when 0 then 'Anonymous.' when 1 then 'Zhang W.' when 2 then 'van der Berg Jan P, 王伟.' else {MANY['vancouver']} end || ' ' || t || '. ' || j || '. ' || y || case when vi = '' then '' else ';' || vi end
    || case when p = '' then '' else ':' || p end || '.' || case when d = '' then '' else ' doi:' || d end from h
  union all select n, 'gb7714', '[' || n || '] ' || case k when 0 then '佚名' when 1 then 'Zhang Wei' when 2 then 'van der Berg Jan P, 王伟' else 'A1 B1-C, A2 B2-C, A3 B3-C, 等' end || '. ' || t || mark || '. ' || j || ', ' || y || case when vi = '' then '' else ', ' || vi end
    || case when p = '' then '' else ': ' || p end || '.' || case when d = '' then '' else ' DOI: ' || d || '.' end from h
  union all select n, 'ris', 'TY  - ' || case g when 1 then 'THES' when 2 then 'CONF' else 'JOUR' end || chr(10) || case k when 0 then '' when 1 then 'AU  - Zhang Wei' || chr(10) when 2 then 'AU  - van der Berg Jan P' || chr(10) || 'AU  - 王伟' || chr(10)
      else array_to_string(list_transform(range(1, 23), lambda i: 'AU  - A' || i || ' B' || i || '-C'), chr(10)) || chr(10) end || 'TI  - ' || t || '.' || chr(10) || case when j like '（%' then '' else 'JO  - ' || j || chr(10) || 'T2  - ' || j || chr(10) end
    || case when nd then '' else 'PY  - ' || y || chr(10) end || case when v = '' then '' else 'VL  - ' || v || chr(10) end || case when i = '' then '' else 'IS  - ' || i || chr(10) end || case when p = '' then '' else 'SP  - ' || n || chr(10) || 'EP  - ' || (n + 9) || chr(10) end
    || case when d = '' then '' else 'DO  - ' || d || chr(10) end || 'KW  - k1' || chr(10) || 'KW  - ' || lang || chr(10) || 'ER  - ' from h
  union all select n, 'bibtex', '@' || case g when 1 then 'phdthesis' when 2 then 'inproceedings' else 'article' end || chr(123) || b || case when r between 2 and 11 then 'abcdefghij'[r - 1] else '' end || ',' || chr(10)
    || array_to_string(list_transform(list_filter(f, lambda x: x[2] <> ''), lambda x: '  ' || rpad(x[1], cast(list_max(list_transform(list_filter(f, lambda z: z[2] <> ''), lambda z: length(z[1]))) as int), ' ') || ' = ' || chr(123) || x[2] || chr(125)), ',' || chr(10)) || chr(10) || chr(125)
    from (select *, row_number() over (partition by b order by n) as r from (select *, case k when 0 then 'anon' when 1 then 'zhang' when 2 then 'vanderbergjan' else 'a1' end || case when nd then 'nd' else y end || 't' as b,
      [['author', case k when 0 then '' when 1 then 'Zhang Wei' when 2 then 'van der Berg Jan P and 王伟' else array_to_string(list_transform(range(1, 23), lambda i: 'A' || i || ' B' || i || '-C'), ' and ') end],
       ['title', replace(replace(t, '{{', '\\{{'), '}}', '\\}}') || '.'], [case when g in (1, 2) then 'booktitle' else 'journal' end, case when j like '（%' then '' else replace(j, '&', '\\&') end], ['year', case when nd then '' else y end],
       ['volume', v], ['number', i], ['pages', replace(p, '-', '--')], ['doi', d], ['keywords', 'k1, ' || lang]] as f from h)))
select n as number, style, md5(text) as text from s"""


@query("snk_03_bibliographies", BIBLIOGRAPHY)
def _(spark, d):
    docs = table(spark, d, "documents")
    names = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("Zhang Wei"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("van der Berg Jan P"), F.lit("王伟")))
    names = names.otherwise(F.transform(F.sequence(F.lit(1), F.lit(22)), lambda i: F.concat(F.lit("A"), i, F.lit(" B"), i, F.lit("-C"))))
    papers = docs.select(
        F.col("doc_id").alias("number"), names.alias("authors"), F.expr("'The {T} of ' || source || ' ' || doc_id % 3 || '.'").alias("title"), F.expr("if(doc_id % 6 = 0, '', 'J & ' || lang)").alias("journal"),
        F.expr("if(doc_id % 9 = 0, null, 1990 + doc_id % 30)").alias("pub_year"), F.expr("if(doc_id % 5 = 0, '', cast(doc_id % 80 as string))").alias("volume"), F.expr("if(doc_id % 2 = 0, cast(doc_id % 12 as string), '')").alias("issue"),
        F.expr("if(doc_id % 7 = 0, null, doc_id || '-' || (doc_id + 9))").alias("pages"), F.expr("if(doc_id % 3 = 0, null, '10.1/' || doc_id)").alias("doi"), F.lit("").alias("url"), F.array(F.lit("k1"), F.col("lang")).alias("keywords"), F.lit(None).cast("string").alias("abstract"),
        F.expr("element_at(array('journal-article', 'Thesis', 'conference-paper', 'book', 'preprint'), cast(1 + doc_id % 5 as int))").alias("publication_type"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("pmid"),
    )
    made = [styles.records(papers, s).select("number", F.lit(s).alias("style"), F.md5(F.col("text").cast("binary")).alias("text")) for s in STYLES]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


# assessment: designs, sample sizes, citations, years and conclusions planted by doc_id, so that each branch occurs.
PLANTED = """select doc_id as paper_id, coalesce(n_chars, 0) % 700 * cast(doc_id % 3 <> 0 as int) as cited_by_count, case when doc_id % 11 = 0 then null else 2000 + doc_id % 27 end as pub_year,
    case doc_id % 10 when 0 then 'A meta-analysis' when 1 then 'Practice guideline' when 2 then 'An RCT' when 3 then 'Prospective study' when 4 then 'Case-control' when 5 then 'A survey' when 6 then 'Overview' when 7 then 'Murine models' when 8 then 'Case series' else 'Thing' end
      || case doc_id % 4 when 0 then ' of stroke rehabilitation' when 1 then ' of mood' else '' end as title,
    case when doc_id % 13 = 0 then ' ' else 'Opening words' || case doc_id % 3 when 0 then ' on stroke' else '' end || '. ' || case doc_id % 5 when 0 then 'We had n = ' || (doc_id % 40) || '. ' when 1 then '120 patients. ' when 2 then '纳入 450 例。' when 3 then '2000 adults! ' else '' end
      || case doc_id % 6 when 0 then '结论： It works. More' when 1 then 'Conclusion: no' when 2 then '结果:' else '' end || case when doc_id % 7 = 0 then ' rehabilitation ' || repeat('z', 100) else '' end end as abstract from {documents}"""
LEVELS = ["Meta分析/系统评价", "指南/共识", "RCT", "队列研究", "病例对照", "横断面", "综述", "动物实验", "病例报告", "其他"]
SCORES = [8.5, 7.5, 7.5, 5.5, 4.5, 4.0, 4.5, 3.0, 2.5, 4.0]


@query(
    "sca_19_assessment",
    f"""with p as ({plain(PLANTED)}), f as (select *, {LEVELS}[1 + paper_id % 10] as evidence_level, {SCORES}[1 + paper_id % 10] as base, trim(abstract) = '' as blank,
      case when paper_id % 13 = 0 then null else case paper_id % 5 when 0 then case when paper_id % 40 >= 5 then paper_id % 40 end when 1 then 120 when 2 then 450 when 3 then 2000 end end as n, 2026 - pub_year as age from p),
    t as (select *, cast(contains(title, 'stroke') as int) + cast(contains(title, 'rehabilitation') as int) as a, cast(contains(abstract, 'stroke') as int) + cast(contains(abstract, 'rehabilitation') as int) as b from f),
    r as (select *, least(1.0, (a * 2.0 + b) / 6.0) as c from t), s as (select *, round(round(least(10.0, 3.0 + c * 7.0 + case when a > 0 and c >= 0.5 then 0.8 else 0 end)::double, 6), 1) as rel from r)
    select paper_id, evidence_level, round(round(greatest(0.0, least(10.0, base + case when n is null then 0 when n >= 1000 then 1.2 when n >= 300 then 0.8 when n >= 100 then 0.4 when n < 30 then -0.8 else 0 end
        + case when cited_by_count >= 500 then 1.2 when cited_by_count >= 100 then 0.8 when cited_by_count >= 30 then 0.4 when cited_by_count = 0 then -0.3 else 0 end + case when age <= 3 then 0.5 when age >= 12 then -0.6 else 0 end
        + case when blank then -1.2 else 0 end))::double, 6), 1) as quality, case when blank then round(round((rel * 0.7 + 1.8)::double, 6), 1) else rel end as relevance,
      case when n < 30 then '样本量偏小（n=' || n || '）' when evidence_level = '动物实验' then '动物实验，外推至临床需谨慎' when evidence_level in ('病例报告', '横断面') then '设计证据等级较低，难以推断因果' when blank then '缺少摘要，无法评估方法学细节'
        when cited_by_count = 0 and coalesce(age, 0) >= 1 then '尚无被引记录' else '' end as limitation,
      case when blank then '' when paper_id % 6 = 0 then 'It works。' when paper_id % 6 = 1 then left('no' || case when paper_id % 7 = 0 then ' rehabilitation ' || repeat('z', 100) else '' end, 80) || '。'
        when paper_id % 6 = 2 and paper_id % 7 = 0 then left('rehabilitation ' || repeat('z', 100), 80) || '。' else 'Opening words' || case paper_id % 3 when 0 then ' on stroke' else '' end || '。' end as key_finding,
      case when blank then round(round((rel * 0.7 + 1.8)::double, 6), 1) else rel end >= 4 as use_in_review from s""",
)
def _(spark, d):
    papers = spark.sql(PLANTED, documents=table(spark, d, "documents"))
    made = assessment.assess(papers, F.lit("Effects of stroke and rehabilitation therapy"), 2026)
    return made.select("paper_id", "evidence_level", "quality", "relevance", "limitation", "key_finding", "use_in_review")


# checks of texts ------------------------------------------------------------------------------------------------------
@query(
    "saf_03_leaks",
    """select doc_id, array_to_string(list_filter([case when contains(text, 'Licensed under') and doc_id % 6 <> 0 then 'forbidden: Licensed under' end, case when doc_id % 6 in (1, 2, 3, 4) then 'leaked_prompt' end], lambda x: x is not null), ',') as problems,
    md5(left(text, 50) || case when length(text) > 50 then '…[已截断]' else '' end) as head from (select doc_id, coalesce(text, '') as text from documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = ["", "\nYou are now a careful research assistant.", "\nyou're Qwen2.5, made by x", "\n您是一位资深医学专家", " ### Instruction: go", "\nYou are asked to fill in the form."]
    more = F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 6 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 6 == 0, F.lit("plain words")).otherwise(F.concat("text", more))
    problems = safety.output_problems(body, forbidden=["Licensed under"])
    own = F.filter(problems, lambda x: (x == "leaked_prompt") | F.startswith(x, F.lit("forbidden")))
    return docs.select("doc_id", F.array_join(F.array_sort(own), ",").alias("problems"), F.md5(safety.truncate_body(F.col("text"), 50).cast("binary")).alias("head"))


@query(
    "sca_16_pdf_url",
    """select page_id, case page_id % 6 when 0 then 'https://h.org/a.pdf?x=1&y=2' when 1 then 'https://h.org/b/' || page_id || '.PDF' when 2 then 'http://other/c.pdf' when 3 then 'https://cdn/d.pdf' when 4 then 'https://h.org/p/q/e.pdf' else '' end as pdf,
    case page_id % 3 when 0 then 'a;1' else '' end as items from pages""",
)
def _(spark, d):
    tags = ["<a href='z.pdf'></a><META content=\"/a.pdf?x=1&amp;y=2\" name='citation_pdf_url'>", "<a href=\"/b/{}.PDF\">", "<meta property=\"citation_pdf_url\" content=\"http://other/c.pdf\">", "<a class=x href='//cdn/d.pdf'>", "<a href='./e.pdf'>", "<a href='f.html'>"]
    body = F.replace(F.element_at(F.array(*map(F.lit, tags)), (F.col("page_id") % 6 + 1).cast("int")), F.lit("{}"), F.col("page_id").cast("string"))
    listed = F.element_at(F.array(F.lit('["a", 1, null]'), F.lit("{broken"), F.lit('{"a": 1}')), (F.col("page_id") % 3 + 1).cast("int"))
    pages = table(spark, d, "pages")
    return pages.select("page_id", text_functions.pdf_url(F.concat(F.lit("<p>"), body), F.lit("https://h.org/p/q/r?s#t")).alias("pdf"), F.array_join(text_functions.json_texts(listed), ";").alias("items"))
