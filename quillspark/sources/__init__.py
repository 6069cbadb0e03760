"""Readers, writers and the fixture views over the driver tables."""

from quillspark.sources.tables import read_table  # noqa: F401
