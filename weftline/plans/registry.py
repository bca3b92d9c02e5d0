"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import q_dispatch, q_docs, q_models, q_more, q_ordered  # noqa: F401  (the others add their queries to the first one's)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(q_dispatch.QUERIES)
ORACLE_SQL: dict[str, str] = dict(q_dispatch.ORACLE_SQL)
