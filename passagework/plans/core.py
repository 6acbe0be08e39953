"""All queries of the library itself."""

from . import measure_queries, relation_queries, retrieval_queries, rule_queries, search_queries, selection_queries, source_queries, spoken_queries, text_queries, word_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
