"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltline.plans import analytics, monitoring, roundtrips, scalars

FLAGSHIP = "denied_per_source_day"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**roundtrips.QUERIES, **analytics.QUERIES, **monitoring.QUERIES, **scalars.QUERIES}
ORACLE_SQL: dict[str, str] = {**roundtrips.ORACLE_SQL, **analytics.ORACLE_SQL, **monitoring.ORACLE_SQL, **scalars.ORACLE_SQL}
