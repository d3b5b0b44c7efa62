"""The queries for code provenance and their SQL."""

from __future__ import annotations

from kinfold.plans import catalog, executables, graphs, kernels, lineage, linkage, matching, search
from kinfold.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "executables", "graphs", "kernels", "lineage", "linkage", "matching", "search"]
