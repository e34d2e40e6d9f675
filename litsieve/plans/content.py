"""Appraisal, claim checking and safety over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from litsieve.functions import rules
from litsieve.operators import analytics, claims, flow, safety
from litsieve.sources.adapters import table, view

from .base import query


def drafts(spark, d):
    return view(spark, d, "drafts_v")


def sources(spark, d):
    """Sources 1 to 3 of every draft: the documents that the labels' order puts 1 to 3 places after it, so each text is a source of three drafts."""
    labels = table(spark, d, "labels").select("doc_id").distinct()
    cites = labels.select(F.col("doc_id").alias("draft_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("cite_id"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("source_text"))
    return cites.withColumn("source_id", F.col("draft_id") + F.col("cite_id")).join(texts.hint("merge"), "source_id").select("draft_id", "cite_id", "source_text")


SENTENCES = """lines as (select draft_id, unnest(string_split(draft, chr(10))) as raw, generate_subscripts(string_split(draft, chr(10)), 1) - 1 as line from drafts_v),
    kept as (select * from lines where not starts_with(trim(raw), '#') and not regexp_matches(raw, '^\\s*[\\[【]\\d{1,3}[\\]】]\\s+\\S')),
    cut as (select draft_id, line, unnest(regexp_extract_all(raw, '[^。！？!?；;\\n]+[。！？!?；;]?')) as s from kept),
    sent as (select draft_id, line, trim(s) as s, list_sort(list_distinct(list_transform(regexp_extract_all(s, '\\[(\\d)\\]', 1), lambda x: x::int))) as c from cut where length(trim(s)) >= 8)"""


@query("clm_01_claims", f"with {SENTENCES} select draft_id, line, md5(substr(s, 1, 400)) as digest, array_to_string(c, ',') as cites from sent where len(c) > 0", "drafts_v")
def _(spark, d):
    made = claims.claims(drafts(spark, d))
    return made.select("draft_id", "line", F.md5(F.substring("claim", 1, 400).cast("binary")).alias("digest"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("cites"))


@query("clm_03_coverage", f"with {SENTENCES} select draft_id, count(*) as sentences, count(*) filter (len(c) > 0) as cited from sent group by 1", "drafts_v")
def _(spark, d):
    return claims.coverage(drafts(spark, d))


@query("clm_04_missing_sources", f"with {SENTENCES} select draft_id, line, md5(substr(s, 1, 400)) as digest from sent where exists (select 1 from unnest(c) as t(x) where x not between 1 and 3 or draft_id + x not in (select doc_id from documents))", "drafts_v")
def _(spark, d):
    held = claims.with_sources(claims.claims(drafts(spark, d)), sources(spark, d))
    return held.where(F.size("missing") > 0).select("draft_id", "line", F.md5(F.substring("claim", 1, 400).cast("binary")).alias("digest"))


@query("clm_05_10_check")
def _(spark, d):
    return claims.check(claims.claims(drafts(spark, d)), sources(spark, d)).groupBy("verdict", F.array_join("rules", "+").alias("rules")).agg(F.count("*").alias("n"))


# RE2 has no look-around: every sign but word signs and the point stands three times, so that neighbours don't share one.
# White space only belongs to a number where % or ‰ follows; every third sign of that tail is the tail as it was.
PROVENANCE = """with bare as (select draft_id, regexp_replace(regexp_replace(draft, '[\\[【]\\s*(\\d{1,3}(?:\\s*[,，\\-–]\\s*\\d{1,3})*)\\s*[\\]】]', ' ', 'g'), '([^\\w.])', '\\1\\1\\1', 'g') as b from drafts_v),
    found as (select draft_id, list_distinct(list_filter(list_transform(regexp_extract_all(b, '(?:^|[^\\w.\\[])(\\d+(?:\\.\\d+)?(?:\\s*(?:%%%|‰‰‰))?)(?:$|[^\\w\\]])', 1), lambda v: regexp_extract(v, '^[0-9.]+') || array_to_string(string_split(substr(v, 1 + length(regexp_extract(v, '^[0-9.]+'))), '')[1:-:3], '')),
      lambda v: v not in ('0', '1', '2', '3', '4', '5') and not regexp_matches(v, '^(19|20)\\d{2}$'))) as numbers from bare),
    held as (select l.doc_id as draft_id, string_agg(d.text, chr(10) order by k) as source from (select distinct doc_id from labels) l, (values (1), (2), (3)) as t(k), documents d where d.doc_id = l.doc_id + k group by 1),
    each as (select f.draft_id, v, trim(regexp_replace(v, '[%‰]', '', 'g')) as w, coalesce(source, '') as source from (select draft_id, unnest(numbers) as v from found) f left join held using (draft_id)),
    lost as (select draft_id, count(*) as unknown from each where not (contains(source, v) or contains(source, w) or contains(source, regexp_replace(regexp_replace(w, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''))
      or contains(source, format('{:.1f}', w::double)) or contains(source, format('{:.2f}', w::double)) or (w::double = floor(w::double) and contains(source, cast(cast(floor(w::double) as hugeint) as varchar)))) group by 1),
    made as (select draft_id, cast(len(numbers) as int) as numbers, cast(coalesce(unknown, 0) as int) as unknown from found left join lost using (draft_id))
    select *, case when numbers = 0 then 'no_numbers' when unknown = 0 then 'pass' when unknown <= greatest(2, floor(numbers * 0.1)) then 'warn' else 'fail' end as status from made"""


@query("clm_11_number_provenance", PROVENANCE, "drafts_v")
def _(spark, d):
    return claims.number_provenance(drafts(spark, d), sources(spark, d))


@query("agg_19_draft_report")
def _(spark, d):
    return claims.report(claims.check(claims.claims(drafts(spark, d)), sources(spark, d)), claims.coverage(drafts(spark, d)))


@query("clm_15_issues")
def _(spark, d):
    return claims.issues(claims.check(claims.claims(drafts(spark, d)), sources(spark, d))).select("draft_id", "claim_id", "verdict", "n")


@query(
    "agg_18_confusion",
    "with c as (select case when quality = 0 then 'unsupported' else 'supported' end as gold, case when toxic = 1 then 'contradicted' when doc_id % 5 = 0 then 'unsupported' else 'supported' end as p from labels) "
    "select gold, count(*) filter (p = 'supported') as supported, 0::bigint as weakly_supported, 0::bigint as unverifiable, count(*) filter (p = 'unsupported') as unsupported, 0::bigint as overclaim, count(*) filter (p = 'contradicted') as contradicted, count(*) as support, round(count(*) filter (p = gold) / count(*), 4) as recall from c group by 1",
)
def _(spark, d):
    gold = F.when(F.col("quality") == 0, "unsupported").otherwise("supported")
    predicted = F.when(F.col("toxic") == 1, "contradicted").when(F.col("doc_id") % 5 == 0, "unsupported").otherwise("supported")
    return claims.confusion(table(spark, d, "labels").select(gold.alias("gold"), predicted.alias("predicted")))


@query(
    "joi_18_tier_merge",
    "select doc_id, case when case j when 'contradicted' then 3 else 0 end > case v when 'unsupported' then 1 else 0 end then j else v end as verdict from (select doc_id, case when quality = 0 then 'unsupported' else 'supported' end as v, case when toxic = 1 then 'contradicted' else 'supported' end as j from labels)",
)
def _(spark, d):
    labels = table(spark, d, "labels")
    own = labels.select(F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 0, "unsupported").otherwise("supported").alias("verdict"))
    judged = labels.select(F.col("doc_id").alias("claim_id"), F.when(F.col("toxic") == 1, "contradicted").otherwise("supported").alias("judged"))
    return claims.merge_tiers(own, judged).select(F.col("claim_id").alias("doc_id"), "verdict")


def saf_02_sql() -> str:
    """RE2 has neither lookarounds nor possessive runs: a value that ends in no, one or more = is masked by a replacement each."""
    v, replaces = safety.VALUE, [(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", safety.PEM_MASK)]
    replaces += [(r"(^|[^A-Za-z0-9_-])(sk-[A-Za-z0-9_-])[A-Za-z0-9_-]{5,}([A-Za-z0-9_-]{2})", r"\1\2***\3"), (r"\b(ghp_)[A-Za-z0-9]{14,}([A-Za-z0-9]{2})", r"\1***\2"), (r"\b(gith)ub_pat_\w{18,}(\w{2})", r"\1***\2")]
    for _, before, _ in safety.SECRETS[2:4]:
        replaces += [(rf"{before}({v}{{4}}){v}{{4,}}=*(==)", r"\1\2***\3"), (rf"{before}({v}{{4}}){v}{{3,}}({v}=)", r"\1\2***\3"), (rf"{before}({v}{{4}}){v}{{2,}}({v}{{2}})", r"\1\2***\3")]
    replaces += [(rf"{safety.SECRETS[4][1]}({v}{{4}}){v}{{2,}}({v}{{2}})", r"\1\2***\3"), (r"(-----BEGIN )[A-Z0-9 ]{1,6}(PRIVATE KEY-----)", r"\1***\2"), (r"(-----BEGIN )([A-Z0-9 ]{4})[A-Z0-9 ]+([A-Z0-9 ]{2}PRIVATE KEY-----)", r"\1\2***\3")]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = "coalesce(text, '')"
    for pattern, by in replaces:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    plain = lambda before: before.replace(r"(?<![A-Za-z0-9_-])()", "(?:^|[^A-Za-z0-9_-])").replace(r"\b()", r"\b")
    kinds = ", ".join(f"case when regexp_matches(text, {quoted(plain(b) + value)}) then '{n}' end" for n, b, value in safety.SECRETS)
    return f"select doc_id, md5({out}) as digest, array_to_string(list_filter([{kinds}], lambda x: x is not null), ',') as kinds from documents"


@query("saf_02_redact", saf_02_sql())
def _(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(safety.redact(text).cast("binary")).alias("digest"), F.array_join(safety.secret_kinds(text), ",").alias("kinds"))


@query("saf_03_output_check", "select doc_id, length(text) > 20000 as too_long, contains(text, 'Licensed under') as forbidden from documents where length(text) > 20000 or contains(text, 'Licensed under')")
def _(spark, d):
    problems = safety.output_problems(F.col("text"), max_chars=20_000, forbidden=["Licensed under"])
    # a generator keeps the tests above the checks, which are then made once a text and not once a test
    checked = table(spark, d, "documents").select("doc_id", F.explode(F.array(problems)).alias("problems"))
    made = checked.select("doc_id", F.array_contains("problems", "too_long").alias("too_long"), F.array_contains("problems", "forbidden: Licensed under").alias("forbidden"))
    return made.where("too_long or forbidden")


@query("saf_05_brackets", "select page_id, md5(regexp_replace(html || '<<<<', '([<>＜＞]{2})[<>＜＞]+', '\\1', 'g')) as digest from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(safety.neutralize_brackets(F.concat("html", F.lit("<<<<"))).cast("binary")).alias("digest"))


def sca_17_sql() -> str:
    """RE2's word boundary knows ASCII letters only, so it is spelled out."""
    edge = "[^\\p{L}\\p{N}_]"
    animals = rules.ANIMALS.replace("\\b(", f"(?:^|{edge})(", 1).replace(")\\b", f")(?:$|{edge})", 1)
    levels = " ".join(f"when {' or '.join(f"contains(h, '{w}')" for w in words)} then '{name}'" for name, words, _ in rules.DESIGNS)
    return f"select paper_id, case when regexp_matches(h, '{animals}') then '动物实验' {levels} else '其他' end as level from (select paper_id, lower(' ' || coalesce(title, '') || ' ' || substr(coalesce(abstract, ''), 1, 1500)) as h from papers_v)"


@query("sca_17_evidence_level", sca_17_sql(), "papers_v")
def _(spark, d):
    return view(spark, d, "papers_v").select("paper_id", rules.evidence_level(F.col("title"), F.col("abstract")).alias("level"))


@query("sca_18_sample_size", "select doc_id, n_chars as n from documents where n_chars between 5 and 500000")
def _(spark, d):
    said = F.concat(F.lit("We had n = "), F.col("n_chars").cast("string"), F.lit(" and 3 patients"))
    return table(spark, d, "documents").select("doc_id", rules.sample_size(said, F.lit("")).cast("long").alias("n")).where("n is not null")


@query("agg_14_evidence_grade", "select source as run_id, round(avg(cited_by_count / 60.0), 4) as mean_quality, count(*) filter (cited_by_count >= 450) as high, case when round(avg(cited_by_count / 60.0), 4) >= 7 and count(*) filter (cited_by_count >= 450) >= 3 then 'A' when round(avg(cited_by_count / 60.0), 4) >= 6 and count(*) filter (cited_by_count >= 450) >= 1 then 'B' when round(avg(cited_by_count / 60.0), 4) >= 4.5 then 'C' else 'D' end as grade from papers_v group by 1", "papers_v")
def _(spark, d):
    made = view(spark, d, "papers_v").groupBy(F.col("source").alias("run_id")).agg(F.round(F.avg(F.col("cited_by_count") / 60.0), 4).alias("mean_quality"), F.count_if(F.col("cited_by_count") >= 450).alias("high"))
    return made.withColumn("grade", analytics.grade(F.col("mean_quality"), F.col("high")))


@query(
    "agg_10_review_flow",
    """with f as (select query as review_id, cast(sum(result_count) as bigint) as identified, cast(greatest(sum(result_count - new_count), 0) as bigint) as duplicates from search_logs_v group by 1),
    h as (select 'q' || cast(doc_id % 20 as varchar) as review_id, count(*) filter (quality = 0) as excluded_at_screening, count(*) filter (toxic = 1) as not_retrieved, 0::bigint as excluded_at_fulltext, count(*) filter (quality = 1 and toxic = 0) as included from labels group by 1),
    d as (select f.*, coalesce(excluded_at_screening, 0) as excluded_at_screening, coalesce(not_retrieved, 0) as not_retrieved, 0::bigint as excluded_at_fulltext, coalesce(included, 0) as included, greatest(identified - duplicates, 0) as screened from f left join h using (review_id)),
    e as (select *, greatest(screened - excluded_at_screening, 0) as sought from d), g as (select *, greatest(sought - not_retrieved, 0) as assessed from e)
    select *, array_to_string(list_filter([case when identified = 0 then 'nothing_identified' end, case when duplicates > identified then 'more_duplicates_than_records' end, case when sought > screened - excluded_at_screening then 'more_sought_than_screened' end, case when assessed > sought - not_retrieved then 'more_assessed_than_retrieved' end, case when included > assessed - excluded_at_fulltext then 'more_included_than_left' end], lambda x: x is not null), ',') as warnings from g""",
    "search_logs_v",
)
def _(spark, d):
    logs = view(spark, d, "search_logs_v").withColumnRenamed("query", "review_id")
    labels = table(spark, d, "labels").withColumn("review_id", F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")))
    stages = F.array_compact(F.array(F.when(F.col("quality") == 0, "excluded_at_screening"), F.when(F.col("toxic") == 1, "not_retrieved"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "included")))
    return flow.review_flow(logs, labels.select("review_id", F.explode(stages).alias("stage"), F.lit(1).cast("long").alias("n")))
