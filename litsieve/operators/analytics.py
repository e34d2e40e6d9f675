"""Aggregates over logs, usage, feedback, spans and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices per million tokens (in, out) by model prefix.
PRICES = {
    "ollama": (0.0, 0.0), "qwen": (0.0, 0.0), "llama": (0.0, 0.0), "mistral": (0.0, 0.0), "gemma": (0.0, 0.0), "phi": (0.0, 0.0), "deepseek-r1": (0.0, 0.0),
    "deepseek-chat": (2.0, 8.0), "deepseek-reasoner": (4.0, 16.0), "deepseek": (2.0, 8.0), "gpt-4o-mini": (1.0, 4.0), "gpt-4o": (18.0, 72.0), "gpt-4": (180.0, 360.0),
    "qwen-max": (20.0, 60.0), "qwen-plus": (0.8, 2.0), "claude": (22.0, 110.0), "moonshot": (12.0, 12.0), "glm": (1.0, 1.0),
}


def search_log_summary(logs: DataFrame) -> DataFrame:
    """Per source and in total (source null): results, new ones, failures, searches, distinct queries."""
    return logs.rollup("source").agg(
        F.sum("result_count").alias("results"), F.sum("new_count").alias("new_results"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("searches"), F.countDistinct("query").alias("queries"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.cube("verdict", "category").agg(F.count("*").alias("n"))


def with_cost(usage: DataFrame) -> DataFrame:
    """usage with cost: by the longest price prefix of the model; names with a colon are local and free, unknown ones cost 0."""
    model = F.lower(F.trim("model"))
    price = None
    for prefix in sorted(PRICES, key=len, reverse=True):  # the longest prefix is tried first
        pair = F.struct(F.lit(PRICES[prefix][0]).alias("input"), F.lit(PRICES[prefix][1]).alias("output"))
        price = (F.when if price is None else price.when)(F.startswith(model, F.lit(prefix)), pair)
    paid = F.when(~F.contains(F.col("model"), F.lit(":")), price)
    cost = (F.greatest("prompt_tokens", F.lit(0)) * paid["input"] + F.greatest("completion_tokens", F.lit(0)) * paid["output"]) / 1e6
    return usage.withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6))


def usage_summary(usage: DataFrame) -> DataFrame:
    """One row in total and one per model, per phase and per error kind, with exact latency percentiles."""
    spark = usage.sparkSession
    return spark.sql(
        """select model, phase, error_kind, count(*) as calls, count_if(ok) as ok_calls, count_if(not ok) as failed_calls,
             sum(prompt_tokens) as prompt_tokens, sum(completion_tokens) as completion_tokens, round(sum(cost), 4) as cost,
             round(percentile(latency_ms, 0.5), 4) as p50, round(percentile(latency_ms, 0.95), 4) as p95,
             count(distinct model) as models
           from {usage} group by grouping sets ((), (model), (phase), (error_kind))
           having grouping(error_kind) = 1 or error_kind is not null""",
        usage=usage,
    )


def span_rows(traces: DataFrame) -> DataFrame:
    """traces (trace_id, spans array<struct<name, status, duration_ms, depth>>) as one row per span."""
    return traces.select("trace_id", F.inline("spans"))


def span_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.round(F.max("duration_ms"), 3).alias("max_ms"), F.count_if(F.col("status") == "error").alias("errors"))


def library_stats(papers: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: papers, with abstract, years, embedded papers and their share."""
    own = papers.agg(F.count("*").alias("papers"), F.count_if(F.coalesce("abstract", F.lit("")) != "").alias("with_abstract"), F.min("pub_year").alias("min_year"), F.max("pub_year").alias("max_year"))
    held = embedded.agg(F.countDistinct("paper_id").alias("embedded"))
    return own.join(held).withColumn("coverage", F.round(F.col("embedded") / F.greatest("papers", F.lit(1)), 4))  # one row each


def failure_stats(attempts: DataFrame) -> DataFrame:
    """attempts (seq, label, permanent, example): count and first example of each label."""
    return attempts.groupBy("label", "permanent").agg(F.count("*").alias("n"), F.min_by("example", "seq").alias("example"))


def paper_penalty(feedback: DataFrame, least: float = 0.5) -> DataFrame:
    hits = feedback.where("verdict = 'challenge' and corrected_text <> ''").where(F.col("category").isin("fact", "citation", "overreach")).where(F.rlike("target_id", F.lit("^\\d+$")))
    return hits.groupBy(F.col("target_id").cast("long").alias("paper_id")).agg(F.count("*").alias("n")).withColumn("factor", F.round(F.greatest(F.lit(least), 1 - 0.1 * F.col("n")), 4))


def source_penalty(feedback: DataFrame, min_ratio: float = 0.6, min_samples: int = 5, least: float = 0.5) -> DataFrame:
    own = feedback.where("target_type = 'search_result'").groupBy(F.lower(F.trim("target_id")).alias("source"))
    rated = own.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "up").alias("good")).withColumn("ratio", F.col("good") / F.col("n"))
    return rated.where((F.col("n") >= min_samples) & (F.col("ratio") < min_ratio)).select("source", "n", F.round(F.greatest(F.lit(least), "ratio"), 4).alias("factor"))


def apply_penalties(hits: DataFrame, penalties: DataFrame) -> DataFrame:
    """hits (query_id, paper_id, score) with the paper's factor applied, ranked anew."""
    scored = hits.join(penalties.select("paper_id", "factor"), "paper_id", "left").withColumn("score", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6))
    return scored.drop("factor").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "paper_id")))


def correction_memories(feedback: DataFrame, topic: str, limit: int) -> DataFrame:
    """Of the newest 4 * limit corrected challenges, those of the topic first, then the newest."""
    recent = feedback.where("verdict = 'challenge' and corrected_text <> ''").orderBy(F.col("id").desc()).limit(4 * limit)
    return recent.withColumn("same_topic", F.col("topic") == topic).orderBy(F.col("same_topic").desc(), F.col("id").desc()).limit(limit)


def preference_pairs(feedback: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, meta) where both sides are there."""
    both = feedback.where("trim(corrected_text) <> '' and trim(quoted_text) <> ''")
    return both.select("id", F.format_string("[%s] %s", "category", "topic").alias("prompt"), F.col("corrected_text").alias("chosen"), F.col("quoted_text").alias("rejected"), F.struct("run_id", "target_type", "target_id").alias("meta"))


def outcome_report(results: DataFrame) -> DataFrame:
    """results (query, source, result_count, duration_ms, error): per query, sources that failed with their errors and counts."""
    each = results.groupBy("query", "source").agg(F.sum("result_count").alias("found"), F.max("error").alias("error"), F.sum("duration_ms").alias("duration_ms"))
    errors = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("source", "error")))))
    return each.groupBy("query").agg(F.count("*").alias("sources"), F.count_if(F.col("error").isNull()).alias("ok"), F.sum("found").alias("raw_count"), F.to_json(errors).alias("errors"))


def step_summary(steps: DataFrame, payload: str = "payload") -> DataFrame:
    """Per run step, from its JSON payload: number of paper ids, length of the draft, whether there is a critique."""
    own = F.from_json(payload, "paper_ids array<long>, draft string, critique string")
    return steps.select("run_id", "phase", F.coalesce(F.size(own["paper_ids"]), F.lit(0)).alias("papers"), F.coalesce(F.char_length(own["draft"]), F.lit(0)).alias("draft_chars"), own["critique"].isNotNull().alias("has_critique"))


def grade(mean_quality: Column, high: Column) -> Column:
    """Evidence grade of a run from mean quality and the number of high-level designs."""
    return F.when((mean_quality >= 7) & (high >= 3), "A").when((mean_quality >= 6) & (high >= 1), "B").when(mean_quality >= 4.5, "C").otherwise("D")
