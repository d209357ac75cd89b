"""All registered queries with their check SQL."""

from docketry.plans import (
    queries_cache,
    queries_eval,
    queries_receipts,
    queries_records,
    queries_stream,
    queries_text,
)

_GROUPS = (
    queries_text, queries_receipts, queries_cache, queries_eval, queries_records, queries_stream,
)


def queries():
    return {name: query for group in _GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql():
    return {
        name: sql.strip()
        for group in _GROUPS
        for name, (_, sql) in group.QUERIES.items()
        if sql is not None
    }
