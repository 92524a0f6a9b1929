"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

Codebooks are found in rounds of assignment and averaging in whole numbers. The first assignment compares
a part with all entries and keeps its b closest ones with ordered lower bounds of their distances, and one
outer bound for all others (Drake and Hamerly's adaptive bounds). After the entries have moved, the bounds
shrink by the movements; a part whose distance to its entry lies below a bound needs no comparison with
the entries beyond it. What the bounds leave uncertain is decided by whole-number distances, so results
are those of comparing all. b adapts to what the last round needed. Bounds and parts are stored between
rounds; codebooks and sums per entry are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augspark.operators.skew import broadcast_if_small, join_keys
from augspark.session import cut_lineage, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Rows that are handled together
ROWS = 2048
# Whole numbers up to this in absolute value, so that sums of a part's squares fit into 64 bits
LARGEST = 1 << 28
# Square roots of doubles are trusted up to this share of themselves
SLACK = 1e-12


@dataclass
class Codebooks:
    """entries: (part, entry, component) whole numbers; drift: how far each entry has moved from the last ones, rounded up."""

    entries: np.ndarray
    drift: np.ndarray | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved_to(self, entries: np.ndarray) -> Codebooks:
        way = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(float))
        return Codebooks(entries, way * (1 + SLACK))


def _below(values: np.ndarray) -> np.ndarray:
    """The values in single precision, rounded down."""
    short = values.astype(np.float32)
    return np.where(short > values, np.nextafter(short, np.float32(-np.inf)), short)


def assign_all(points: np.ndarray, books: Codebooks, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and the next b of each part, and their lower bounds with the outer one.

    points: (rows, parts, components). Ids: (rows, parts, b + 1); bounds: (rows, parts, b + 1).
    """
    rows, parts, _ = points.shape
    k = books.entries.shape[1]
    ids = np.zeros((rows, parts, b + 1), np.uint8)
    low = np.full((rows, parts, b + 1), np.inf, np.float32)
    for p in range(parts):
        d = ((points[:, p, None, :] - books.entries[p]) ** 2).sum(2)
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]  # the lower index of equal ones first
        ids[:, p] = order[:, : b + 1]
        near = np.sqrt(np.take_along_axis(d, order[:, 1:], 1).astype(float)) * (1 - SLACK)
        low[:, p, : near.shape[1]] = _below(near)  # with all entries listed, nothing is beyond the outer bound
    assert k > b
    return ids, low


def reassign(points: np.ndarray, ids: np.ndarray, low: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids and bounds after the entries have moved, the squared distances, and the most listed entries that some part needed."""
    rows, parts, width = points.shape
    b, k = ids.shape[2] - 1, books.entries.shape[1]
    x = points.reshape(rows * parts, width)
    book, drift = books.entries.reshape(parts * k, width), books.drift.ravel()
    base = np.tile(np.arange(parts) * k, rows)
    ids, low = ids.reshape(-1, b + 1).copy(), low.reshape(-1, b + 1).astype(float)
    low[:, :b] -= drift[base[:, None] + ids[:, 1:]]
    low[:, b] -= np.tile(books.drift.max(1), rows)
    low = _outwards(low)
    own = ((x - book[base + ids[:, 0]]) ** 2).sum(1)
    ok = (np.sqrt(own.astype(float)) * (1 + SLACK))[:, None] < low
    need = np.where(ok.any(1), ok.argmax(1), -1)
    for m in range(1, b + 1):
        at = np.flatnonzero(need == m)
        if not len(at):
            continue
        near = ids[at, : m + 1].astype(np.int64)
        d = ((x[at, None] - book[base[at, None] + near]) ** 2).sum(2)
        by = np.lexsort((near, d), axis=1)
        near, d = np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1)
        ids[at, : m + 1], own[at] = near, d[:, 0]
        low[at, :m] = np.sqrt(d[:, 1:].astype(float)) * (1 - SLACK)
    low = _below(_outwards(low))
    ids, low, own = ids.reshape(rows, parts, b + 1), low.reshape(rows, parts, b + 1), own.reshape(rows, parts)
    # rows with a part that no bound settles are compared with all entries again, and bounds start anew
    again = np.flatnonzero((need < 0).reshape(rows, parts).any(1))
    if len(again):
        ids[again], low[again] = assign_all(points[again], books, b)
        chosen = books.entries[np.arange(parts), ids[again, :, 0]]
        own[again] = ((points[again] - chosen) ** 2).sum(2)
    return ids, low, own, int(need.max(initial=0))


def _outwards(low: np.ndarray) -> np.ndarray:
    """Each bound holds for its entry and all further out."""
    return np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


def whole_parts(vectors: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """(rows, parts, components) of floor(scale * x); zeros fill up vectors that do not cut into equal parts."""
    rows, dim = vectors.shape
    width = -(-dim // parts)
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"vector codes take components up to {LARGEST // scale} in absolute value")
    whole = np.zeros((rows, parts * width), np.int64)
    whole[:, :dim] = scaled
    return whole.reshape(rows, parts, width)


def _binary(values: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = len(values)
    size = values.nbytes // rows if rows else 0
    offsets = np.arange(rows + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _matrix(column: pa.Array, dtype, shape: tuple[int, ...]) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype).reshape(len(column), *shape)


def _mapped(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield step(batch.slice(lo, ROWS))

    return df.mapInArrow(run, schema)


def _averaged(stored: DataFrame, books: Codebooks, b: int) -> np.ndarray:
    """Every entry as the floor of its parts' mean; unused entries stay. Sums are taken per task, then in Spark."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(parts * k, np.int64)
        sums = np.zeros((parts * k, width), np.int64)
        for batch in batches:
            points = _matrix(batch.column(0), "<i4", (parts * width,)).reshape(batch.num_rows * parts, width).astype(np.int64)
            ids = _matrix(batch.column(1), np.uint8, (parts, b + 1))[:, :, 0]
            slot = (ids + np.arange(parts) * k).ravel()
            count += np.bincount(slot, minlength=parts * k)
            for c in range(width):
                np.add.at(sums[:, c], slot, points[:, c])
        used = np.flatnonzero(count)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), values], names=["slot", "n", "sums"])

    partial = stored.select("points", "ids").mapInArrow(run, "slot bigint, n bigint, sums array<bigint>")
    totals = [F.sum(F.get("sums", F.lit(c)).cast("decimal(38,0)")).alias(f"s{c}") for c in range(width)]
    out = books.entries.copy().reshape(parts * k, width)
    for row in partial.groupBy("slot").agg(F.sum("n").alias("n"), *totals).collect():  # parts x entries rows at most
        out[row["slot"]] = [int(row[f"s{c}"]) // row["n"] for c in range(width)]
    return out.reshape(books.entries.shape)


def _coded(vectors: DataFrame, carried: list[str], dim: int, parts: int, entries: int, rounds: int, scale: int) -> DataFrame:
    """Codes of the vectors of one length; the first carried column orders the first entries."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col(carried[0]).asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    books = Codebooks(whole_parts(np.array([r["_vector"] for r in first], float).reshape(len(first), dim), parts, scale).swapaxes(0, 1))
    k, width = books.entries.shape[1:]
    least = min(max(k // 8, 1), k - 1)
    b = min(max(k // 4, 1), k - 1)
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{kinds}, points binary, ids binary, low binary, used int"
    names = [*carried, "points", "ids", "low", "used"]

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(len(carried))
        points = whole_parts(np.asarray(column.flatten(), float).reshape(batch.num_rows, dim), parts, scale)
        ids, low = assign_all(points, books, b)
        packed = [_binary(points.astype("<i4")), _binary(ids), _binary(low.astype("<f4")), pa.array(np.zeros(len(ids), np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *packed], names=names)

    def read(batch: pa.RecordBatch, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = _matrix(batch.column("points"), "<i4", (parts, width)).astype(np.int64)
        return points, _matrix(batch.column("ids"), np.uint8, (parts, held + 1)), _matrix(batch.column("low"), "<f4", (parts, held + 1))

    def store(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "vector-codes")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    stored = store(_mapped(vectors.select(*carried, "_vector"), schema, begin))
    for number in range(rounds):
        books = books.moved_to(_averaged(stored, books, b))
        if number == rounds - 1:
            break
        held, most = b, stored.agg(F.max("used")).first()[0] or 0
        # the first assignment tells nothing about what rounds need, so its b stays for one round
        b = held if number == 0 else max(least, min(held, most))

        def step(batch: pa.RecordBatch, held=held, b=b, books=books) -> pa.RecordBatch:
            points, ids, low = read(batch, held)
            ids, low, _, used = reassign(points, ids, low, books)
            packed = [batch.column("points"), _binary(ids[:, :, : b + 1]), _binary(low[:, :, : b + 1]), pa.array(np.full(len(ids), used, np.int32))]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *packed], names=names)

        stored = store(_mapped(stored, schema, step))
    digest, held, final = books.digest(), b, books

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, ids, low = read(batch, held)
        ids, _, own, _ = reassign(points, ids, low, final)
        code = [row.tobytes().hex() for row in ids[:, :, 0]]
        packed = [pa.array(code, pa.string()), pa.array(own.sum(1)), pa.array([digest] * len(code), pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *packed], names=[*carried, "code", "error", "codebooks_sha256"])

    return _mapped(stored, f"{kinds}, code string, error bigint, codebooks_sha256 string", finish)


def vector_codes(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Per vector: key, label (if named), code, error and codebooks_sha256.

    Components become floor(scale * x). Each of the equal parts of a vector has a codebook, which starts as
    that part of the vectors with the ``entries`` smallest keys (null keys last, equal ones by their vector)
    and moves to the floor of the mean of its parts in every round. code: the entry of each part, two hex
    digits each; error: the squared distances summed over the parts.

    Vectors that are null or hold null or non-finite components give no row. Repeated keys and vectors
    count as rows. Vectors of different lengths have codebooks of their own, one run per length; zeros fill
    up lengths that do not cut into equal parts. Components above 2^28 / scale in absolute value raise an
    error. No rows give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits name at most 256 entries")
    carried = [key, *([label] if label else [])]
    named = [f"_c{i}" for i in range(len(carried))]
    e = F.col(embedding)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(*[F.col(c).alias(n) for c, n in zip(carried, named, strict=True)], e.alias("_vector"))
    lengths = sorted(r[0] for r in rows.select(F.size("_vector")).distinct().collect())  # one row per vector length
    runs = [_coded(rows.where(F.size("_vector") == d), named, d, parts, entries, rounds, scale) for d in lengths]
    if not runs:
        kinds = rows.select(*named)
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "bigint"), ("codebooks_sha256", "string"))]
        runs = [kinds.where(F.lit(False)).select(*named, *empty)]
    return reduce(DataFrame.unionByName, runs).withColumnsRenamed(dict(zip(named, carried, strict=True)))


def with_error_per_label(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the errors of all rows with the same label; null labels belong together.

    Sums are taken before the shuffle. They are broadcast after a look at their size; else rows meet them by label.
    """
    coded = cut_lineage(coded)
    sums, _ = broadcast_if_small(cut_lineage(coded.groupBy(label).agg(F.sum("error").alias("label_error"))))
    return join_keys(coded, sums, [label])
