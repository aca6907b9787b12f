"""Named queries and the SQL that each must agree with.

A plan module offers ``PLANS``, a registry of queries (functions of a session and a
table folder) and of DuckDB SQL over the same tables.
"""
from importlib import import_module

MODULES = ("versions", "facets", "ranking", "money", "nested", "aggregates", "joins", "sets", "text", "checks", "entities", "pages", "details", "structures", "requests")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        own = import_module(f"{__name__}.{name}").PLANS
        clash = queries.keys() & own.queries.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        queries |= own.queries
        oracle |= own.oracle
    return queries, oracle
