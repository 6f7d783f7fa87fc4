"""Registration of driver queries with their oracle SQL."""

from __future__ import annotations


class Family:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def query(self, sql: str | None = None):
        """Register the decorated function under its own name."""

        def register(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.oracle[fn.__name__] = sql
            return fn

        return register
