"""All queries of the conversation engine and their SQL."""

from __future__ import annotations

import functools

from ..shipping import ship
from . import detail_queries, file_queries, interval_queries, record_queries, render_queries, table_queries


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


MODULES = (interval_queries, table_queries, record_queries, detail_queries, render_queries, file_queries)
QUERIES = {name: _shipped(q) for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
