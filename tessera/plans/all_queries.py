"""All queries of the library but those of the training-data package."""

from tessera.plans import code_queries, consolidation_queries, ranking_queries, report_queries  # noqa: F401  they register themselves
from tessera.plans.catalog_queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
