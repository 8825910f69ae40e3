"""Registered queries by family."""

from docflow.plans import layout, lists, live, pages, script, structure, values  # noqa: F401
from docflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
