"""All registered queries; importing the parts fills the registry."""

from synthspark.plans import (  # noqa: F401
    catalog_generators,
    catalog_profile,
    catalog_rules,
    catalog_scores,
    catalog_streaming,
)
from synthspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
