"""Feature selection and classification on wide numeric tables, on Spark."""

from traitsieve.table import FeatureTable

__all__ = ["FeatureTable"]
