"""The review flow from the search log and a table of screening decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_flow(logs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per review: records identified, after dedup, screened, sought, assessed, included, and what doesn't add up.

    logs (review_id, result_count, new_count); decisions (review_id, stage, n), stage one of excluded_at_screening,
    not_retrieved, excluded_at_fulltext, included. Derived counts are clamped at 0.
    """
    found = logs.groupBy("review_id").agg(F.sum("result_count").alias("identified"), F.greatest(F.sum(F.col("result_count") - F.col("new_count")), F.lit(0)).alias("duplicates"))
    stages = ["excluded_at_screening", "not_retrieved", "excluded_at_fulltext", "included"]
    held = decisions.groupBy("review_id").agg(*[F.coalesce(F.sum(F.when(F.col("stage") == s, F.greatest("n", F.lit(0)))), F.lit(0)).alias(s) for s in stages])
    df = found.join(held.hint("merge"), "review_id", "left").na.fill(0, stages)
    df = df.withColumn("screened", F.greatest(F.col("identified") - F.col("duplicates"), F.lit(0)))
    df = df.withColumn("sought", F.greatest(F.col("screened") - F.col("excluded_at_screening"), F.lit(0)))
    df = df.withColumn("assessed", F.greatest(F.col("sought") - F.col("not_retrieved"), F.lit(0)))
    warnings = F.array_compact(F.array(
        F.when(F.col("identified") == 0, "nothing_identified"),
        F.when(F.col("duplicates") > F.col("identified"), "more_duplicates_than_records"),
        F.when(F.col("sought") > F.col("screened") - F.col("excluded_at_screening"), "more_sought_than_screened"),
        F.when(F.col("assessed") > F.col("sought") - F.col("not_retrieved"), "more_assessed_than_retrieved"),
        F.when(F.col("included") > F.col("assessed") - F.col("excluded_at_fulltext"), "more_included_than_left"),
    ))
    return df.withColumn("warnings", F.array_join(warnings, ","))
