"""Bulk loads with a report that is gathered while the job writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from litsieve.operators.snapshots import Library
from litsieve.sources.articles import matching
from litsieve.store import written


def load(papers: DataFrame, library: Library | None = None, terms: str = "", year_from: int | None = None, year_to: int | None = None, require_abstract: bool = False) -> dict:
    """Filters papers (with `fulltext`, if there is any) and merges them into the library; without one it is a dry run.

    -> seen, matched, with_fulltext, created, merged and ten of the titles. The counts are observed on the rows as they
    pass to the one table that is written, so nothing is read a second time for them."""
    seen, matched = Observation("seen"), Observation("matched")
    text = F.coalesce(F.col("fulltext"), F.lit("")) if "fulltext" in papers.columns else F.lit("")
    kept = matching(papers.observe(seen, F.count("*").alias("n")), terms, year_from, year_to, require_abstract)
    kept = kept.observe(matched, F.count("*").alias("n"), F.count_if(text != "").alias("full"))
    rows = written(kept, "bulk")
    made = {"seen": seen.get["n"], "matched": matched.get["n"], "with_fulltext": matched.get["full"], "created": 0, "merged": 0}
    if library is not None:
        done = {r["action"]: r["count"] for r in library.apply(rows).groupBy("action").count().collect()}
        made |= {"created": done.get("new", 0), "merged": made["matched"] - done.get("new", 0)}
    return made | {"sample_titles": [r["title"] for r in rows.select("title").limit(10).collect()]}
