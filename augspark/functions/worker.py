"""What Python workers hold: models for their whole life, of the texts of a batch only a slice."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

# Values that are taken from an Arrow column at once, and characters of results that are gathered for Arrow:
# a batch of Spark's holds up to 10,000 texts of any length
SLICE_ROWS, SLICE_CHARS = 64, 1 << 20


def loaded(factory: Callable, token: str):
    """What the factory makes, once per Python worker.

    The package travels by value, so its globals live for one task; the model is kept in a module of its
    own instead, under ``token``, which names the factory.
    """
    home = sys.modules.setdefault("_augspark_models", types.ModuleType("_augspark_models"))
    if token not in home.__dict__:
        home.__dict__[token] = factory()
    return home.__dict__[token]


def values_of(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of Arrow columns as Python values, a few at a time."""
    for at in range(0, len(columns[0]), SLICE_ROWS):
        yield from zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in columns), strict=True)


def gathered(rows: Iterator, size: Callable[..., int]) -> Iterator[list]:
    """Lists of consecutive rows: about SLICE_CHARS by ``size`` each, a row at least."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def release_memory() -> None:
    """Gives freed memory back to the system, since idle Python workers would keep it beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
