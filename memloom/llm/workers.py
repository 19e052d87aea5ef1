"""Python workers stay alive between stages, so what a step freed is given back when it ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def batched(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that releases at its end."""

    def step(it: Iterator) -> Iterator:
        yield from run(it)
        release()

    return step


def grouped(run: Callable) -> Callable:
    """A step over a group that releases at its end."""

    def step(pdf):
        out = run(pdf)
        release()
        return out

    return step


def cogrouped(run: Callable) -> Callable:
    """A step over a pair of groups that releases at its end."""

    def step(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return step
