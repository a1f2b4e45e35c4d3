"""All queries outside the ``llm`` subpackage, and their SQL."""

from skeinwork.plans import enumeration_queries, graph_queries, hierarchy_queries, media_queries, prototype_queries, report_queries, session_queries, subgraph_queries, text_queries

_MODULES = [text_queries, session_queries, graph_queries, subgraph_queries, enumeration_queries, prototype_queries, report_queries, media_queries, hierarchy_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
