"""Exports of paper tables as distributed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """Arrays joined by "; ", line ends as spaces."""
    kinds = dict(df.dtypes)
    flat = {c: F.array_join(c, "; ") if kinds[c].startswith("array") else F.regexp_replace(c, r"[\r\n]+", " ") for c in df.columns if kinds[c].startswith("array") or kinds[c] == "string"}
    return df.withColumns(flat)


def export_csv(papers: DataFrame, path: str) -> None:
    _flat(papers).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def export_json(papers: DataFrame, path: str) -> None:
    """With the derived dedup key; null fields are left out."""
    from litsieve.operators.resolve import dedup_key

    papers.withColumn("dedup_key", dedup_key(papers)).write.option("ignoreNullFields", True).mode("overwrite").json(path)


def export_preference_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


# What a golden set keeps of a paper.
CORPUS = "title abstract authors journal pub_year doi pmid pmcid keywords mesh_terms publication_type language is_open_access cited_by_count".split()


def golden_lines(cases: DataFrame) -> DataFrame:
    """cases (query, relevant, notes, source, tags, expect_no_relevant) as JSON lines in `value`; the flag only where it is set."""
    flag = F.when(F.col("expect_no_relevant"), True).alias("expect_no_relevant")
    return cases.select(F.to_json(F.struct("query", "relevant", "notes", "source", "tags", flag)).alias("value"))


def corpus_lines(papers: DataFrame) -> DataFrame:
    """papers as JSON lines in `value`, without null, empty, zero and false fields; an id in `doc` is kept, as files have no order of lines."""
    kinds = dict(papers.dtypes)

    def filled(c: str):
        some = F.size(c) > 0 if kinds[c].startswith("array") else F.col(c) != "" if kinds[c] == "string" else F.col(c) if kinds[c] == "boolean" else F.col(c) != 0
        return F.when(some, F.col(c)).alias(c)

    return papers.select(F.to_json(F.struct(*(filled(c) for c in ['doc', *CORPUS] if c in kinds))).alias("value"))


def export_golden(cases: DataFrame, papers: DataFrame, path: str) -> None:
    """A golden set as two folders of JSON lines, `golden` and `corpus`."""
    golden_lines(cases).write.mode("overwrite").text(f"{path}/golden")
    corpus_lines(papers).write.mode("overwrite").text(f"{path}/corpus")
