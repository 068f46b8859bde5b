"""All queries of the engine's own operators."""

from __future__ import annotations

from . import assembly, detection, logs, metrics, serving, streams  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
