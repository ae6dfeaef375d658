"""What a Python worker keeps from one task to the next: one thing at a time, and nothing of another operator."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: list = [None, None]


def kept(owner: Any, make: Callable[[], Any]) -> Any:
    """What `make` gave for `owner`; what was kept for another owner is freed first."""
    if _held[0] != owner:
        free()
        _held[:] = [owner, make()]
    return _held[1]


def free() -> None:
    """Forgets what is kept and gives free memory back to the system."""
    _held[:] = [None, None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
