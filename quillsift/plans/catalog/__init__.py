"""Importing this package registers every query."""

from quillsift.plans.catalog import models, quality, streams, tables, tallies, text, topics  # noqa: F401
