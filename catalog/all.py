"""Importing this module registers every query."""

from catalog import metrics, outcomes, parsing, reads, sessions, talk  # noqa: F401
