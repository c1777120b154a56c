"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from . import anchors, basics, files, generation, graphs, merges, paths, reports, retrieval, texts  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
