"""All registered queries."""

from __future__ import annotations

from stayrate.plans import explore_queries, model_queries, score_queries
from stayrate.plans.registry import Query

QUERIES: dict[str, Query] = {
    **score_queries.QUERIES,
    **explore_queries.QUERIES,
    **model_queries.QUERIES,
}
