"""All named queries of the review engine, with the SQL that they are held against."""

from quillspan.plans import call_queries, module_rule_queries, review_queries, rule_queries, shape_queries  # noqa: F401  register their queries
from quillspan.plans.queries import ORACLE_SQL, QUERIES
from quillspan.plans.review_queries import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
