"""Helpers for functions that run in Spark tasks: texts as one byte buffer, word spans, hashes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from augspark.functions.worker import release_memory

# Texts are handled in buffers of about this many bytes, whatever the size of an Arrow batch
BLOCK_BYTES = 1 << 20
# The white space of `[^\x20\x09-\x0D]+`
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# The byte between two texts of a buffer; it is white space, so no word crosses it
GAP = 0x0A
_ODD = 0x9E3779B97F4A7C15


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a string or binary column as (lo, hi, buffer, starts, ends).

    Text i of a block is ``buffer[starts[i]:ends[i]]``, followed by one GAP byte. Null counts as empty.
    A block holds at least one text, so a text longer than ``limit`` is a block by itself.
    """
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        lens = np.diff(offsets[lo : hi + 1])
        starts = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
        buf = np.full(int(lens.sum()) + hi - lo, GAP, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[starts + lens] = False
        buf[inside] = data[offsets[lo] : offsets[hi]]
        yield lo, hi, buf, starts, starts + lens
        lo = hi
    release_memory()


def byte_table(values) -> np.ndarray:
    """A truth value per byte."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def word_spans(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of a block."""
    word = ~byte_table(SPACES)[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first, last, np.searchsorted(ends, first, "right")


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z become a-z, all other bytes stay."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept by the worker for the next block."""

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            out.append(np.cumprod(powers))
        return out[0], out[1]

    if n > BLOCK_BYTES * 2:
        return make(n)
    held = worker_state("powers", lambda: make(BLOCK_BYTES * 2))
    return held[0][:n], held[1][:n]


class SpanHash:
    """64-bit hashes of any spans of a buffer, all taken from one running sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        powers, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        values = table[buf]
        values *= powers[:n]
        np.cumsum(values, out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.inverse[first])

    def all_of_size(self, size: int) -> np.ndarray:
        """Unmixed hashes of the spans of one size at every place; :func:`mix` gives the usual ones."""
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


def counts_per_text(text_of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many items (or which sum of weights) each of n texts has, as integers."""
    return np.bincount(text_of, weights=weights, minlength=n).astype(np.int64)


def worker_state(name: str, make):
    """A value kept for the life of a Python worker, so that the tasks of one worker share it.

    The package travels by value, so its own globals live for one task only.
    """
    import sys
    import types

    home = sys.modules.setdefault("_augspark_worker_state", types.ModuleType("_augspark_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
