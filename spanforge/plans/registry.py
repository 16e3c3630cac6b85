"""All registered queries of the engine and their oracles."""

from . import catalog_queries, format_queries, learning_queries, session_queries, source_queries, span_queries, state_queries  # noqa: F401  they register themselves
from .relations import ORACLES, QUERIES, Relations  # noqa: F401
