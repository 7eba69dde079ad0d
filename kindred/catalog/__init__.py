"""Every operator as a named query over the given tables, with its SQL twin where one exists."""

from kindred.catalog import (  # noqa: F401
    aggregates, changes, composites, filters, hooks, joins, scalars, scans, sorts, streams, windows)
from kindred.catalog.base import REGISTRY  # noqa: F401
