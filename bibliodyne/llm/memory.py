"""What a Python worker holds after its task."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system. A worker lives on, idle, beside the tasks of the next operators, and
    the allocators would keep what its largest batch took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
