"""Plain descriptions of rules, links and score points."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class Constraint:
    """One rule on one column.

    Row rules: ``not_null``, ``range`` (min, max), ``enum`` (allowed_values), ``regex`` (pattern).
    Table rules: ``unique``, ``foreign_key`` (parent_values, or the name of a parent table and its key).
    """

    column: str
    constraint_type: str
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        """``referential`` is another name of ``foreign_key``."""
        return "foreign_key" if self.constraint_type == "referential" else self.constraint_type


@dataclass(frozen=True)
class Relationship:
    """Parent key to child key."""

    parent_table: str
    parent_key: str
    child_table: str
    child_key: str
    cardinality: str = "1:N"


EVALUATION_POINT = T.StructType(
    [
        T.StructField("generator_type", T.StringType()),
        T.StructField("epsilon", T.DoubleType()),
        T.StructField("fidelity_score", T.DoubleType()),
        T.StructField("privacy_score", T.DoubleType()),
        T.StructField("utility_score", T.DoubleType()),
        T.StructField("training_time_s", T.DoubleType()),
        T.StructField("generation_time_s", T.DoubleType()),
        T.StructField("num_rows", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Objective weights by preset name.
WEIGHT_PRESETS = {
    "balanced": {"fidelity": 0.5, "privacy": 0.5},
    "fidelity_first": {"fidelity": 0.8, "privacy": 0.2},
    "privacy_first": {"fidelity": 0.2, "privacy": 0.8},
    "equal_three": {"fidelity": 0.33, "privacy": 0.33, "utility": 0.34},
}

# Fixed values: (epsilon, delta) by privacy level.
PRIVACY_LEVELS = {
    "strict": (0.1, 1e-6),
    "moderate": (1.0, 1e-5),
    "lenient": (5.0, 1e-4),
    "disabled": (float("inf"), 0.0),
}

# Thresholds and limits.
FIDELITY_THRESHOLD = 0.75
PRIVACY_THRESHOLD = 0.50
COLUMN_THRESHOLD = 0.60
READY_FIDELITY = 0.70
READY_PRIVACY = 0.50
SAMPLE_ROWS_MIN, SAMPLE_ROWS_MAX = 100, 1_000_000
EXPORT_CHUNK_ROWS = 100_000
CHUNKED_EXPORT_ROWS = 500_000
OUTPUT_PART_ROWS = 500_000
HISTORY_LENGTH = 200
