"""All queries of the subpackage, and their SQL."""

from skeinwork.llm import queries as _q

QUERIES = dict(_q.QUERIES)
SQL = dict(_q.SQL)
