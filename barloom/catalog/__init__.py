"""Registered queries: each has a Spark plan and, where SQL can say it, an equivalent SQL text."""

from barloom.catalog import base
from barloom.catalog import decisions, evaluation, features, ingest, models, statements  # noqa: F401

QUERIES = base.QUERIES
