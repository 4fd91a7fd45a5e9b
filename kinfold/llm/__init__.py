"""Corpus operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from kinfold.llm.common import REGISTRY, SQL


def load() -> None:
    from kinfold.llm import queries  # noqa: F401


__all__ = ["REGISTRY", "SQL", "load"]
