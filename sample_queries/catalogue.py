"""Importing this module registers every query."""

from sample_queries import analysis, history, star_schema  # noqa: F401
