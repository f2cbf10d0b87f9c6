"""Import every family so that its queries are registered."""
from tapeloom.plans import bar_queries, exhaustion_queries, card_queries, valuation_queries, event_queries, strategy_queries, price_queries, message_queries, read_queries, stream_queries  # noqa: F401
from tapeloom.plans.registry import CHECKS, QUERIES, check_sql  # noqa: F401
