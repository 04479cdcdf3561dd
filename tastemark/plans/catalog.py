"""All registered queries."""

from tastemark.plans import catalog_joins, catalog_keywords, catalog_models, catalog_stored, catalog_tables, catalog_text  # noqa: F401
from tastemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
