"""A registry of queries: the tables they read, the operator they call and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from tenderspark.plans import bind


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, tables: list[str], operator: Callable, sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: operator(*(bind.view(spark, sf_dir, t) for t in tables))
        if sql:
            self.oracles[name] = bind.oracle(sql)
