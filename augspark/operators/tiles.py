"""Log-determinants of matrices that no task holds: symmetric matrices as tables of square tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from augspark.session import cut_lineage

TILE = 256


def product_tiles(vectors: DataFrame, tile: int = TILE, ridge: float = 0.0, centred: bool = True) -> DataFrame:
    """(sample_id, d, i, j, values, tokens): the tiles i >= j of the sum of outer products of each sample's ``vec``.

    centred: each vector loses its own mean first. ``ridge`` is added to the diagonal. A task emits the
    tiles of one batch of rows at a time; they are added up before and after the shuffle. Null vectors
    count for nothing.
    """
    id_type = vectors.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            index = codes.indices.to_numpy(zero_copy_only=False)
            for code, sample in enumerate(codes.dictionary.to_pylist()):
                own = batch.column(1).filter(pa.array(index == code))
                z = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                if centred:
                    z = z - z.mean(axis=1, keepdims=True)
                d = z.shape[1]
                for i in range(0, d, tile):
                    for j in range(0, i + 1, tile):
                        part = z[:, i : i + tile].T @ z[:, j : j + tile]
                        row = {"sample_id": [sample], "d": [d], "i": [i // tile], "j": [j // tile], "values": [part.ravel()], "tokens": [len(z)]}
                        types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int64()]
                        yield pa.record_batch([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    schema = f"sample_id {id_type}, d int, i int, j int, values array<double>, tokens bigint"
    partial = vectors.select("sample_id", "vec").mapInArrow(run, schema)
    summed = partial.groupBy("sample_id", "d", "i", "j").agg(
        vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"), F.sum("tokens").alias("tokens")
    )
    if not ridge:
        return summed
    width = F.least(F.lit(tile), F.col("d") - F.col("i") * tile)
    # the diagonal of a square tile is every (width + 1)-th value
    raised = F.transform("values", lambda x, at: F.when(at % (width + 1) == 0, x + ridge).otherwise(x))
    return summed.withColumn("values", F.when(F.col("i") == F.col("j"), raised).otherwise(F.col("values")))


def _worked(df: DataFrame, columns: list[str], step: Callable[..., tuple]) -> DataFrame:
    """Rows (sample_id, d, i, j) with new ``values`` and ``part`` from a function of d, i, j and the named columns."""
    id_type = df.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # a tile is some hundred kilobytes
                own = batch.slice(r, 1)
                d, i, j = (own.column(c)[0].as_py() for c in (1, 2, 3))
                tiles = [own.column(4 + n).flatten().to_numpy(zero_copy_only=False) for n in range(len(columns))]
                values, part = step(d, i, j, *tiles)
                done = [pa.array([np.ravel(values)], pa.list_(pa.float64())), pa.array([part], pa.float64())]
                yield pa.record_batch([*own.columns[:4], *done], names=["sample_id", "d", "i", "j", "values", "part"])

    schema = f"sample_id {id_type}, d int, i int, j int, values array<double>, part double"
    return df.select("sample_id", "d", "i", "j", *columns).mapInArrow(run, schema)


def log_determinants(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(sample_id, d, log_determinant) of positive definite matrices given as tiles i >= j (sample_id, d, i, j, values).

    Blocked Cholesky decomposition: a step factors the diagonal tiles of one block column, solves the tiles
    below them and takes their products off the rest, tile by tile; three tiles are the most that one row
    holds. Rows are stored after each step, and there are as many steps as block columns.
    """
    size = lambda d, i: min(tile, d - i * tile)

    def factor(d: int, i: int, j: int, a: np.ndarray) -> tuple:
        lower = np.linalg.cholesky(a.reshape(size(d, i), size(d, i)))
        return lower, float(2 * np.log(np.diag(lower)).sum())

    def solve(d: int, i: int, j: int, a: np.ndarray, diagonal: np.ndarray) -> tuple:
        lower = diagonal.reshape(size(d, j), size(d, j))
        return np.linalg.solve(lower, a.reshape(size(d, i), size(d, j)).T).T, 0.0

    def take_off(d: int, i: int, j: int, a: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple:
        inner = len(left) // size(d, i)
        return a.reshape(size(d, i), size(d, j)) - left.reshape(-1, inner) @ right.reshape(-1, inner).T, 0.0

    rest = tiles.select("sample_id", "d", "i", "j", "values")
    blocks = -(-(tiles.agg(F.max("d")).first()[0] or 0) // tile)
    parts = [tiles.where(F.lit(False)).select("sample_id", "d", F.lit(0.0).alias("part"))]
    for k in range(blocks):
        diagonal = cut_lineage(_worked(rest.where((F.col("i") == k) & (F.col("j") == k)), ["values"], factor)).alias("g")
        parts.append(diagonal.select("sample_id", "d", "part"))
        column = rest.where((F.col("j") == k) & (F.col("i") > k)).alias("c")
        both = column.join(diagonal, _same("c", "g"))
        below = cut_lineage(_worked(both.select("c.*", F.col("g.values").alias("lower")), ["values", "lower"], solve))
        left, right, inner = below.alias("l"), below.alias("r"), rest.where(F.col("j") > k).alias("a")
        met = inner.join(left, _same("a", "l") & (F.col("a.i") == F.col("l.i"))).join(right, _same("a", "r") & (F.col("a.j") == F.col("r.i")))
        chosen = met.select("a.*", F.col("l.values").alias("left"), F.col("r.values").alias("right"))
        rest = cut_lineage(_worked(chosen, ["values", "left", "right"], take_off)).drop("part")
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("sample_id", "d").agg(F.sum("part").alias("log_determinant"))


def _same(a: str, b: str):
    return F.col(f"{a}.sample_id").eqNullSafe(F.col(f"{b}.sample_id")) & (F.col(f"{a}.d") == F.col(f"{b}.d"))
