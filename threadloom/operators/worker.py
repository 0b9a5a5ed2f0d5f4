"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable


def kept(key: str, make: Callable[[], object]) -> object:
    """The object under ``key`` of this process, made on first use (functions are shipped by value, so their globals don't last)."""
    cache = sys.__dict__.setdefault("_threadloom_kept", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]
