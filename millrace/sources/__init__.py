"""Readers for the tables of a data folder."""

from millrace.sources.tables import table

__all__ = ["table"]
