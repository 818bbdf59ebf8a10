"""What a Python worker keeps between tasks: one large object at a time.

Spark reuses worker processes, so a tokenizer's caches would otherwise stay in memory while
the next operator needs it.
"""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, object] = {}


def hold(key: str, build: Callable[[], object]):
    """The object of `key`, built on first use; the one held before goes."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def release() -> None:
    _held.clear()
