"""Fitted models on disk."""

from __future__ import annotations

from typing import Any


def save_model(model: Any, path: str) -> None:
    """Save an estimator or fitted model, replacing an older one."""
    model.write().overwrite().save(path)


def load_model(kind: Any, path: str) -> Any:
    """Load what :func:`save_model` wrote; ``kind`` is the class, such as ``KMeansModel``."""
    return kind.load(path)
