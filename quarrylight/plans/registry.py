"""Every registered query by name, with the SQL that gives the same rows."""

from .oracle import ORACLE_SQL
from .queries import QUERIES

FLAGSHIP = "dense_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
