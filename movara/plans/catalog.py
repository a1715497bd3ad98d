"""All registered queries."""

from movara.plans import catalogs, causes, files, ingestion, parsing, periods, profiling, ranking, roles, sketches  # noqa: F401
from movara.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
