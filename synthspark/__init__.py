"""Spark-native synthetic tables: profile, repair, fit, sample, score and export."""

from synthspark.spec import Constraint, Relationship

__all__ = ["Constraint", "Relationship"]
