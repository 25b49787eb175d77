"""One small registry per plan module."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def register(fn):
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return register

    return queries, oracles, query
