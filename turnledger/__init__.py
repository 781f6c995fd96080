"""Spark jobs over coding-agent session logs: turns, costs, attribution, rollups."""
