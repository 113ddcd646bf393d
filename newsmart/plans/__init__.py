"""Ready queries over the test tables, each next to its SQL statement."""

from newsmart.plans import news_analytics, news_history, news_mart, news_text, news_streams  # noqa: F401
from newsmart.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
