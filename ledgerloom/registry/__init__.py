"""All registered queries with their SQL twins."""

from ledgerloom.registry import (  # noqa: F401
    aggregates, filters, joins, jobs, ordering, scalars, setops, sources, streams,
)
from ledgerloom.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
