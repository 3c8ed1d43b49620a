"""Registered queries by family."""
from __future__ import annotations

import importlib
import pkgutil

from .registry import REGISTRY, Query, runner


def registered() -> dict[str, Query]:
    for m in sorted(n for _, n, _ in pkgutil.iter_modules(__path__) if n.startswith("q_")):
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY


__all__ = ["registered", "runner"]
