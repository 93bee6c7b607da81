"""What a reused Python worker keeps between tasks: one large object at most."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_held: dict = {}


def hold(key, make):
    """The worker's object for `key`; whatever it held for another key is given back first."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops what is held, and returns freed memory to the system; tasks without an object of their own begin so."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
