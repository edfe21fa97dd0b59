"""Derived views over the given tables, the registered queries and their SQL twins."""

from __future__ import annotations

import importlib

from gristmill.plans import registry

_MODULES = ("profile_queries", "trace_queries", "compare_queries", "runtime_queries", "redact_queries", "source_queries", "verify_queries", "probe_queries", "jfr_queries", "stream_queries", "profile_text_queries", "import_queries", "report_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"gristmill.plans.{name}")


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
