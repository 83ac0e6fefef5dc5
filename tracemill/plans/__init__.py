"""The driver's queries and their SQL."""

from .workload import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
