"""Registered queries by theme; importing this package fills the registry."""

from . import cleaning, extraction, geography, incremental, models, reports, scoring, tables, text  # noqa: F401
