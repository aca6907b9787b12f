"""How plan modules name their queries."""
from collections.abc import Callable


class Plans:
    """Queries of one module and the SQL that each must agree with."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def named(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Registers a function of (spark, folder) under its own name."""

        def add(f: Callable) -> Callable:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"a second query {key}")
            self.queries[key] = f
            if sql is not None:
                self.oracle[key] = sql
            return f

        return add
