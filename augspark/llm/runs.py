"""Documents dealt into runs of bounded size, and arrays packed into binary columns."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

RUN_BYTES = 8 << 20


def run_count(docs: DataFrame, text: str, run_bytes: int = RUN_BYTES) -> int:
    """How many runs of about ``run_bytes`` the texts fill."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(total // run_bytes) + 1


def dealt_into_runs(docs: DataFrame, runs: int, key: str, text: str, more: Sequence[Column] = ()) -> DataFrame:
    """(run, key, data, ...): the run follows from key and text, so it is the same whenever it is computed."""
    run = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(runs)).cast("int")
    return docs.select(run.alias("run"), F.col(key).alias("key"), F.col(text).cast("binary").alias("data"), *more)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, byte plane by byte plane, so that the exchange compresses them well."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def sorted_counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs (or its sum of weights)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[first], np.diff(first, append=len(values))
    return values[first], np.add.reduceat(weights, first)


def join_parts(parts: Sequence[bytes]) -> bytes:
    """Several byte strings in one, with their lengths in front."""
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    at, out = 4 + 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out
