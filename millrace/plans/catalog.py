"""All queries over the library's operators, and their SQL."""

from . import more_queries as _  # registers its queries beside those of the first module
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
