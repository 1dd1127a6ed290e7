"""Registry of the engine's own queries."""

from weftline.plans import catalog_queries, entity_queries, part_queries, stream_queries, text_queries

_MODULES = (entity_queries, text_queries, catalog_queries, part_queries, stream_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
