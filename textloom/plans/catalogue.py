"""All registered queries and their SQL."""

from __future__ import annotations

from . import more_queries, rule_queries, search_queries, source_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **search_queries.QUERIES, **more_queries.QUERIES, **rule_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **search_queries.ORACLES, **more_queries.ORACLES, **rule_queries.ORACLES, **source_queries.ORACLES}
