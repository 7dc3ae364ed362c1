"""Collects the registered queries of a module."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        """Register a query under its function's name, with its SQL twin if there is one."""
        def add(fn):
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn
        return add
