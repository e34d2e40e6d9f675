"""Views that present the driver's tables in the shape of the library's own (FIXTURES.md); one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Letters and the Chinese characters that stand for them where a view needs such text.
HAN_FOR = ("abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄")

VIEWS = {
    "papers_v": """
select doc_id as paper_id,
  case when n_chars % 3 = 0 then cast(doc_id as string) end as pmid,
  case when n_chars % 5 = 0 then 'PMC' || cast(doc_id as string) end as pmcid,
  case when n_chars % 2 = 0 then '10.1000/' || substr(md5(text), 1, 12) end as doi,
  replace(substr(text, 1, 80), chr(10), ' ') as title,
  replace(substr(text, 81), chr(10), ' ') as abstract,
  'J-' || lang as journal, cast(1990 + doc_id % 35 as int) as pub_year, source, lang as language,
  cast(n_chars % 600 as int) as cited_by_count, doc_id % 3 = 0 as is_open_access, doc_id as ingest_seq
from {documents}""",
    "mixed_papers_v": f"""
select doc_id as paper_id,
  case when doc_id % 4 = 0 then translate(lower(replace(substr(text, 1, 80), chr(10), ' ')), '{HAN_FOR[0]}', '{HAN_FOR[1]}')
    else replace(substr(text, 1, 80), chr(10), ' ') end as title,
  replace(substr(text, 81), chr(10), ' ') as abstract, 'J-' || lang as journal
from {{documents}}""",
    "search_logs_v": """
select event_id as id, 'q' || cast(user_id % 20 as string) as query, event_type as source,
  cast(floor(value) as bigint) as result_count, cast(floor(value / 2) as bigint) as new_count,
  cast(floor(value * 10) as bigint) as duration_ms,
  case when event_type = 'error' then case user_id % 12
    when 0 then 'HTTP 429' when 1 then 'read timed out' when 2 then 'HTTP 503' when 3 then 'connection reset' when 4 then 'HTTP 404' when 5 then 'HTTP 401'
    when 6 then 'maximum context exceeded' when 7 then 'HTTP 422' when 8 then 'json decode error' when 9 then 'request cancelled' when 10 then 'HTTP 405' else 'odd' end end as error, ts as created_at
from {events}""",
    "llm_usage_v": """
select event_id as id,
  case user_id % 4 when 0 then 'deepseek-chat' when 1 then 'deepseek-reasoner' when 2 then 'qwen3:8b' else 'gpt-4o-mini-x' end as model,
  event_type as phase, cast(floor(value * 20) as bigint) as prompt_tokens, cast(floor(value * 7) as bigint) as completion_tokens,
  value * 10 as latency_ms, event_type <> 'error' as ok,
  case when event_type = 'error' then case user_id % 3 when 0 then 'timeout' when 1 then 'rate_limited' else 'parse' end end as error_kind, ts
from {events}""",
    "feedback_v": """
select doc_id as id, case when doc_id % 4 = 0 then 'search_result' else 'paper' end as target_type,
  case when doc_id % 4 = 0 then 'src' || cast(doc_id % 5 as string) else cast(doc_id % 60 as string) end as target_id,
  'r' || cast(doc_id % 9 as string) as run_id,
  case when toxic = 1 then 'challenge' when quality = 0 then 'down' else 'up' end as verdict,
  case doc_id % 3 when 0 then 'fact' when 1 then 'citation' else 'style' end as category,
  case when toxic = 1 or quality = 0 then 'fix ' || cast(doc_id as string) else '' end as corrected_text,
  case when doc_id % 2 = 0 then 'quote ' || cast(doc_id as string) else '' end as quoted_text,
  't' || cast(doc_id % 7 as string) as topic
from {labels}""",
    "citations_v": """
select distinct l_orderkey % 1000 as citing_paper_id,
  case when l_partkey % 1500 < 1000 then l_partkey % 1500 end as cited_paper_id,
  'ext:' || cast(l_partkey % 1500 as string) as cited_external_id, l_returnflag as source
from {lineitem}""",
    "projects_v": "select n_nationkey as id, n_name as name, n_regionkey as region from {nation}",
    "project_papers_v": "select c_nationkey as project_id, c_custkey % 1000 as paper_id from {customer}",
    "agent_runs_v": """
select cast(o_orderkey as string) as run_id, o_custkey as session_id,
  case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'error' end as status,
  o_orderdate as created_at, case when o_orderkey % 3 = 0 then o_orderkey end as artifact_id
from {orders}""",
    "chat_messages_v": "select conv_id * 100 + turn as id, conv_id as session_id, role, text as content from {conversations}",
    "queries_v": "select item_id as query_id, text as query from {benchmark}",
    "qrels_v": """
select b.item_id as query_id, d.doc_id, 1.0 as gain
from {benchmark} b join {documents} d on contains(d.text, b.text)""",
    "drafts_v": """
select d.doc_id as draft_id,
  replace(d.text, '. ', ' [' || cast(1 + d.doc_id % 4 as string) || ']. ') as draft
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables_of(sql)})


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL over the named views."""
    heads = [f"{v} as ({VIEWS[v].format(**{t: t for t in tables_of(VIEWS[v])})})" for v in views]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(heads + [body[15:]])
    if body.lower().startswith("with "):
        return "with " + ", ".join(heads + [body[5:]])
    return ("with " + ", ".join(heads) + " " if heads else "") + body
