"""All queries by name and their SQL."""

from .plans import access, containers, coverage, dependencies, freshness, inventory, listing, packages, paging, queue, readmodels, search, sources, upkeep  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
