"""Named queries over the parquet tables. Importing this package registers all of them."""

from . import action_queries, claim_queries, event_queries, listing_queries, order_queries, payload_queries, policy_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
