"""All registered queries of the retrieval engine and their SQL counterparts."""

from citeloom.plans import corpus, evaluation, linking, parsing, ranking, relational, serving, storage  # noqa: F401
from citeloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
