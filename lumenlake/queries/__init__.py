"""Registered queries of the catalogue's operators over the driver's tables, with SQL oracles."""

from lumenlake.queries import index, match, people, text, views  # noqa: F401
from lumenlake.queries.registry import ORACLES, QUERIES  # noqa: F401
