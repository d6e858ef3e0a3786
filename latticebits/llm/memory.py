"""Give freed memory back: Python workers live on between tasks beside a heap of the executor's own."""

from __future__ import annotations

import ctypes

from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task: one thing at a time, whichever operator was here last."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


EVERY = 24 << 20
_seen = 0


def after(n_bytes: int, every: int = EVERY) -> None:
    """release(), once for every so many bytes of text that a worker has gone through."""
    global _seen
    _seen += n_bytes
    if _seen >= every:
        _seen = 0
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
