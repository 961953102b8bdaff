"""The named queries, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

import importlib

GROUPS = ("sales", "profiling", "cleaning", "relations", "metrics", "charting", "sessions", "streams", "models")


def _entries():
    for group in GROUPS:
        yield from importlib.import_module(f"tablewise.catalog.{group}").QUERIES.items()


def all_queries():
    return {name: run for name, (run, _) in _entries()}


def all_sql():
    return {name: sql for name, (_, sql) in _entries() if sql}
