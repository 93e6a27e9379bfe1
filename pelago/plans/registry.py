"""All registered queries by survey id, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, q_attribution, q_clean, q_evaluation, q_models, q_runs, q_serving, q_sources, q_stats, q_text  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["flagship_kappa_by_segment"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
