"""All query modules, imported once."""

from . import extract, market, matching, normalize, notice, state, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
