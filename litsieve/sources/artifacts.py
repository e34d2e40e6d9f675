"""Written artifacts and traces: sources of a finished text, and span trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.store import written

REFERENCES = "references array<struct<index: string, paper_id: string>>"


def artifact_sources(artifacts: DataFrame, papers: DataFrame, fulltext: DataFrame, together: bool = False) -> DataFrame:
    """artifacts (artifact_id, meta JSON) -> (artifact_id, cite_id, source_text, publication_type, title, journal, pub_year).

    The text is the full text, else the abstract; what describes the paper is given with an abstract only. `together`
    puts title, abstract and full text in a row instead. Of references with one number the last stands; those without a
    whole number go; a broken meta has none. Papers are read once, however many texts cite them.
    """
    refs = artifacts.select("artifact_id", F.posexplode(F.from_json("meta", REFERENCES)["references"]).alias("place", "r"))
    refs = refs.select("artifact_id", F.expr("try_cast(r.index as int)").alias("cite_id"), F.struct("place", F.expr("try_cast(r.paper_id as long)").alias("paper_id")).alias("x")).where("cite_id is not null")
    refs = refs.groupBy("artifact_id", "cite_id").agg(F.max("x").alias("x")).select("artifact_id", "cite_id", "x.paper_id")
    about = ["publication_type", "title", "journal", "pub_year"]
    held = refs.join(fulltext.select("paper_id", F.col("text").alias("_full")).hint("merge"), "paper_id", "left").join(papers.select("paper_id", F.col("abstract").alias("_abstract"), *about).hint("merge"), "paper_id", "left")
    full, abstract = F.trim(F.coalesce("_full", F.lit(""))), F.trim(F.coalesce("_abstract", F.lit("")))
    if together:
        parts = F.filter(F.array(F.trim(F.coalesce("title", F.lit(""))), abstract, full), lambda x: x != "")
        return held.select("artifact_id", "cite_id", F.array_join(parts, "\n").alias("source_text"), *about)
    fallback = full == ""
    return held.select("artifact_id", "cite_id", F.when(fallback, abstract).otherwise(full).alias("source_text"), *(F.when(fallback, F.col(c)).alias(c) for c in about))


def spans(lines: DataFrame) -> DataFrame:
    """lines (value: one trace tree as JSON) -> (trace_id, path, name, status, duration_ms, error) of all spans, at any depth.

    A level of the trees at a time, as variants; each is written, so work follows the number of spans. Broken lines have none.
    """
    tree = lines.select(F.try_parse_json("value").alias("v")).where("v is not null")
    level = tree.select(F.try_variant_get("v", "$.trace_id", "string").alias("trace_id"), F.lit("0").alias("path"), F.try_variant_get("v", "$.root", "variant").alias("node")).where("node is not null")
    found = None
    while True:
        rows = level.select(
            "trace_id", "path", F.try_variant_get("node", "$.name", "string").alias("name"), F.try_variant_get("node", "$.status", "string").alias("status"),
            F.try_variant_get("node", "$.duration_ms", "double").alias("duration_ms"), F.try_variant_get("node", "$.error", "string").alias("error"),
            F.to_json(F.try_variant_get("node", "$.children", "variant")).alias("children"),
        )
        rows = written(rows, "spans")
        own = rows.drop("children")
        found = own if found is None else found.unionByName(own)
        more = rows.where("children like '[{%'")
        if not more.head(1):
            return found
        under = more.select("trace_id", "path", F.posexplode(F.try_variant_get(F.parse_json("children"), "$", "array<variant>")).alias("nth", "node"))
        level = under.select("trace_id", F.concat_ws(".", "path", "nth").alias("path"), "node")


def span_summary(found: DataFrame) -> DataFrame:
    """Per trace and span name: number, total and longest duration, errors."""
    ms = F.round(F.coalesce("duration_ms", F.lit(0.0)), 3)
    return found.groupBy("trace_id", "name").agg(F.count("*").alias("n"), F.round(F.sum(ms), 3).alias("total_ms"), F.max(ms).alias("max_ms"), F.count_if(F.col("status") == "error").alias("errors"))


def append_traces(spark: SparkSession, traces: DataFrame, path: str) -> None:
    """traces (value) as lines of JSON beside those that are there."""
    traces.select("value").write.mode("append").text(path)
