"""All queries of the conversation-risk operators."""

from hearken.plans import corpus, models, scoring, streams  # noqa: F401
from hearken.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
