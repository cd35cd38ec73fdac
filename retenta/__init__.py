"""Churn and attrition analytics as Spark table-to-table operators."""

from retenta.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
