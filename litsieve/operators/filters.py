"""Filters over papers, logs and feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def metadata(df: DataFrame, year_from=None, year_to=None, journal=None, min_cited=None, open_access=None, has_abstract=None, source=None, sources=None) -> DataFrame:
    """Conjunction of the tests given; None, False, 0 and empty values ask for nothing. A null year fails a year test."""
    tests = []
    if year_from:
        tests.append(F.col("pub_year") >= year_from)
    if year_to:
        tests.append(F.col("pub_year") <= year_to)
    if journal:
        tests.append(F.col("journal").ilike(f"%{journal}%"))
    if min_cited:
        tests.append(F.col("cited_by_count") >= min_cited)
    if open_access:
        tests.append(F.col("is_open_access"))
    if has_abstract:
        tests.append(F.coalesce(F.trim("abstract"), F.lit("")) != "")
    if source:
        tests.append(F.col("source") == source)
    if sources:
        tests.append(F.col("source").isin(list(sources)))
    return df.where(_all(tests))


def _haystack(df: DataFrame) -> Column:
    lists = [F.concat_ws(" ", F.col(c)) for c in ("mesh_terms", "keywords") if c in df.columns]
    return F.lower(F.concat_ws(" ", "title", "abstract", *lists))


def bulk(df: DataFrame, terms: list[str] = (), year_from: int | None = None, year_to: int | None = None, require_abstract: bool = False) -> DataFrame:
    """Every term in title, abstract, mesh terms and keywords; a missing year passes the year test."""
    tests = [F.contains(_haystack(df), F.lit(t.strip().lower())) for t in terms if t.strip()]
    if year_from:
        tests.append(F.col("pub_year").isNull() | (F.col("pub_year") >= year_from))
    if year_to:
        tests.append(F.col("pub_year").isNull() | (F.col("pub_year") <= year_to))
    if require_abstract:
        tests.append(F.coalesce(F.trim("abstract"), F.lit("")) != "")
    return df.where(_all(tests))


def relevant(df: DataFrame, words: list[str], min_hits: int = 2, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """At least min(min_hits, number of significant words) of the words occur in title and abstract."""
    terms = [w.lower() for w in words if len(w) > 2 and w.lower() not in stop_words]
    if not terms:
        return df
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hits = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))
    return df.where(hits >= min(min_hits, len(terms)))


def boolean_match(df: DataFrame, must: list[str] = (), any_groups: list[list[str]] = (), exclude: list[str] = (), phrases: list[str] = ()) -> DataFrame:
    """Required words and phrases, one of each group, none of the excluded."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    has = lambda w: F.contains(text, F.lit(w.lower()))
    tests = [has(w) for w in [*must, *phrases]]
    tests += [reduce(lambda a, b: a | b, [has(w) for w in group]) for group in any_groups if group]
    tests += [~has(w) for w in exclude]
    return df.where(_all(tests))


def relative_cut(hits: DataFrame, ratio: float) -> DataFrame:
    """Drops hits below ratio times the best score of their query; a ratio of 0 or less keeps all."""
    if ratio <= 0:
        return hits
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("_best", best).where(F.col("score") >= ratio * F.col("_best")).drop("_best")


def log_window(logs: DataFrame, since=None, queries: list[str] | None = None) -> DataFrame:
    tests = ([F.col("created_at") >= F.lit(since).cast("timestamp")] if since else []) + ([F.col("query").isin(list(queries))] if queries else [])
    return logs.where(_all(tests))


def feedback_list(feedback: DataFrame, limit: int = 50, **equal) -> DataFrame:
    """Newest first; equal: optional equality tests by column."""
    return feedback.where(_all([F.col(k) == v for k, v in equal.items() if v])).orderBy(F.col("id").desc()).limit(limit)


def golden_candidates(papers: DataFrame, limit: int, year_from: int | None = None, min_cited: int = 0, min_abstract: int = 1) -> DataFrame:
    """Most cited papers with an abstract of at least min_abstract characters."""
    kept = metadata(papers, year_from=year_from, min_cited=min_cited).where(F.char_length("abstract") >= min_abstract)
    return kept.orderBy(F.col("cited_by_count").desc(), "paper_id").limit(limit)
