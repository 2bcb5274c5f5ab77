"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from colonnade.catalogue import cleaning, joins, learning, scoring, summaries  # noqa: F401
from colonnade.catalogue.registry import QUERIES, SQL  # noqa: F401
