"""Queries over the benchmark tables, read as session logs."""

from turnledger.catalog import costs, entities, sequences, storage, usage  # noqa: F401  (importing registers)
from turnledger.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
