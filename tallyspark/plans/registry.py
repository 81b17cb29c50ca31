"""The library's own queries; `queries()` and `oracle_sql()` of the driver's contract read these."""

from __future__ import annotations

from tallyspark.plans import agent_queries, chat_queries, limit_queries, quota_queries, service_queries, source_queries, usage_queries
from tallyspark.plans.catalog import ORACLE_SQL, QUERIES

MODULES = (usage_queries, chat_queries, quota_queries, limit_queries, service_queries, agent_queries, source_queries)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
