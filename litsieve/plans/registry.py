"""All registered queries of the library proper with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content, drafts, evaluation, imports, lexical, records, relational, retrieval, streams  # noqa: F401  they fill the register
from .base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_22_config_table"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
