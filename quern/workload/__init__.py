"""Registered queries over the given tables, with the SQL that checks them."""

from quern.workload import domain_queries, feature_queries, language, model_queries, retrieval_queries, shaping, source_queries, statistics  # noqa: F401
from quern.workload.registry import QUERIES, SQL  # noqa: F401
