"""Streams run to their end over the driver's tables, and incremental embedding over several runs."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from litsieve.operators import embedding
from litsieve.sources.adapters import table, view
from litsieve.store import folder
from litsieve.streaming import jobs

from .base import query

RUNS = """select cast(user_id as {text}) as run_id, ts as created_at,
    case event_type when 'click' then 'running' when 'view' then 'awaiting_approval' when 'purchase' then 'done' when 'error' then 'error' else 'running' end as status from {events}"""


def place(spark, name):
    return f"{folder(spark)}/litsieve-streams/{name}-{uuid.uuid4().hex}"


@query(
    "str_04_run_states",
    "with e as (" + RUNS.format(text="varchar", events="events") + """), last as (select run_id, max(created_at) as ended, arg_max(status, (created_at, status)) as status, count(*) as events from e group by 1)
    select run_id, ended as created_at, events, case when status in ('running', 'awaiting_approval') and ended + interval 1 hour <= (select max(created_at) from e) - interval 10 minutes then 'interrupted' else status end as status from last""",
)
def _(spark, d):
    rows = spark.sql(RUNS.format(text="string", events="{events}"), events=table(spark, d, "events"))
    source, target, state = place(spark, "runs"), place(spark, "states"), place(spark, "checkpoint")
    rows.write.parquet(source)
    changes = jobs.run_states(spark.readStream.schema(rows.schema).parquet(source), timedelta(hours=1))
    key, own = next(iter(jobs.RUN_STATE_SETTINGS.items()))
    before = spark.conf.get(key, None)
    spark.conf.set(key, own)
    try:
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/batch={epoch}")
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    made = spark.read.schema("run_id string, status string, created_at timestamp, events long, batch long").parquet(target)
    return made.groupBy("run_id").agg(F.max_by(F.struct("status", "created_at", "events"), "batch").alias("x")).select("run_id", "x.status", F.col("x.created_at").cast("timestamp_ntz").alias("created_at"), "x.events")


def measure(texts: list[str]) -> list[list[float]]:
    """A small provider that fails at texts with three signs of junk."""
    if any("###" in t for t in texts):
        raise ValueError("junk")
    return [[len(t), t.count("a"), t.count("e")] for t in texts]


def measure_all(texts: list[str]) -> list[list[float]]:
    return [[len(t), t.count("a"), t.count("e")] for t in texts]


EMBED = """t as (select paper_id, trim(array_to_string(list_filter([coalesce(title, ''), coalesce(abstract, '')], lambda x: x <> ''), chr(10)), ' ') as t from papers_v),
    s as (select paper_id, t, case when t = '' then 'skipped' when contains(t, '###') then 'failed' else 'embedded' end as status from t)"""


def two_runs(spark, d):
    """The papers of ids below the middle and then the rest arrive in a stream; the provider fails in the first run only."""
    papers = view(spark, d, "papers_v").select("paper_id", "title", "abstract")
    source, target, state = place(spark, "papers"), place(spark, "vectors"), place(spark, "checkpoint")
    for provider, part in ((measure, papers.where("paper_id % 2 = 0")), (measure_all, papers.where("paper_id % 2 = 1"))):
        part.write.mode("append").parquet(source)
        jobs.embed_arrivals(spark.readStream.schema(papers.schema).parquet(source), target, provider, "measure", state, batch_size=1).awaitTermination()
    return embedding.results(spark, target)


@query(
    "ret_09_embedding",
    f"""with {EMBED}, v as (select paper_id, length(t)::double as a, (length(t) - length(replace(t, 'a', '')))::double as b, (length(t) - length(replace(t, 'e', '')))::double as c from s where status <> 'skipped')
    select paper_id, round(a / sqrt(a * a + b * b + c * c), 4) as x, round(b / sqrt(a * a + b * b + c * c), 4) as y, round(c / sqrt(a * a + b * b + c * c), 4) as z from v""",
    "papers_v",
)
def _(spark, d):
    held = embedding.vectors(two_runs(spark, d))
    return held.select("paper_id", *(F.round(F.col("vector")[i].cast("double"), 4).alias(n) for i, n in enumerate("xyz")))


@query(
    "agg_21_embedding_report",
    f"""with {EMBED}, runs as (
      select 0 as batch, status from s where paper_id % 2 = 0
      union all select 1, case when status = 'skipped' then status else 'embedded' end from s where paper_id % 2 = 1 or status = 'failed')
    select batch, 'measure' as model, count(*) as requested, count(*) filter (status = 'embedded') as embedded, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed from runs group by 1""",
    "papers_v",
)
def _(spark, d):
    found = two_runs(spark, d)
    parts = [embedding.report(found.where(F.col("batch") == b)).select(F.lit(b).alias("batch"), "model", "requested", "embedded", "skipped", "failed") for b in (0, 1)]
    return parts[0].unionByName(parts[1])
