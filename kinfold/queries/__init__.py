"""Registered queries: each runs library operators over the shared tables, most with an equivalent SQL text."""

from __future__ import annotations

from kinfold.queries.base import REGISTRY, SQL


def load() -> None:
    from kinfold.queries import (  # noqa: F401
        calibration, experiments, graph, inference, metrics, models, prep, reporting, splitting,
    )


__all__ = ["REGISTRY", "SQL", "load"]
