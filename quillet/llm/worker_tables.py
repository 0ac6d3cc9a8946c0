"""Tables that a Python worker keeps between batches, for one operator at a time.

Workers serve many stages. When another operator's task arrives, the tables of
the last one are emptied, so their sizes don't add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def register(owner: str, clear: Callable[[], None]) -> None:
    _clear[owner] = clear


def claim(owner: str) -> None:
    """Called where a task of ``owner`` begins; memory that earlier tasks have freed goes back to the system."""
    if _owner != [owner]:
        for name, clear in _clear.items():
            if name != owner:
                clear()
        _owner[:] = [owner]
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
