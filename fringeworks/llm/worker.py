"""What a Python worker keeps from one task to the next: one object, of the operator that used the worker last."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_KEPT: dict = {}


def kept(key, make: Callable = lambda: None):
    """The object of ``key``, made where the worker has none; what another operator left is given back first."""
    if key not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def _give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
