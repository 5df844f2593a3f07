"""Every operator as a query over the given tables, with its SQL answer."""

from tapewatch.registry.base import ORACLE, QUERIES  # noqa: F401
from tapewatch.registry import bar_queries, feed_queries, model_queries, stream_queries  # noqa: F401
