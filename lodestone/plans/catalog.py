"""Registry of the engine's queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import store
from lodestone.plans import bindings, q_ops, q_relational, q_text

_MODULES = (q_text, q_relational, q_ops)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most complex English files of at least three points, as summaries."""
    files = bindings.measured(spark, sf_dir)
    return store.compress_by_query(files, "summary", language="en", min_complexity=3).orderBy("complexity", "path", ascending=[False, True]).limit(10)
