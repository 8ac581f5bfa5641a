"""Registered queries of the retrieval and operations library."""

from __future__ import annotations


def queries() -> dict:
    from . import chunking, cleaning, evaluation, retrieval, support, sync, telemetry  # noqa: F401 they register
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from .registry import ORACLES

    return dict(ORACLES)
