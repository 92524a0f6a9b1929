"""Outputs written batch by batch, each batch once, whatever dies in between.

A target folder holds ``rows`` (CSV or another format), ``rejects`` (parquet), ``made`` (what the step
returned, stored before it is split, so that a model runs once) and ``ledger`` (parquet). Each part has a
folder per batch, which a repeated batch overwrites. The ledger entry of a batch is written last: readers
see the batches of the ledger only, so what a dead job left of a batch is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.operators.skew import broadcast_if_small
from augspark.sources.sinks import CSV_READ_OPTIONS, CSV_WRITE_OPTIONS

# From what a step made to the rows to be written and the rejects, which have a column ``error``
Split = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
BATCH = "ledger_batch"


def split_by_error(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an ``error``, and those with one; all rows where there is no such column."""
    if "error" not in made.columns:
        return made, made.select("*", F.lit(None).cast("string").alias("error")).where(F.lit(False))
    failed = F.col("error").isNotNull()
    return made.where(~failed).drop("error"), made.where(failed)


def _folder(target: str, part: str, batch: int | None = None) -> str:
    return f"{target}/{part}" if batch is None else f"{target}/{part}/{BATCH}={batch}"


def _read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    options = CSV_READ_OPTIONS if format == "csv" else {}
    try:
        return spark.read.format(format).options(**options).load(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ledger(spark: SparkSession, target: str) -> DataFrame | None:
    """(batch, n_rows, n_rejects) of every finished batch, or None when there is none yet."""
    return _read(spark, _folder(target, "ledger"))


def is_finished(spark: SparkSession, target: str, batch: int) -> bool:
    return _read(spark, _folder(target, "ledger", batch)) is not None


def next_batch(spark: SparkSession, target: str) -> int:
    found = ledger(spark, target)
    return 0 if found is None else found.agg(F.max("batch")).first()[0] + 1


def write_batch(made: DataFrame, target: str, batch: int, split: Split = split_by_error, format: str = "csv") -> tuple[int, int]:
    """Write a batch unless the ledger has it; returns its numbers of rows and rejects.

    What ``made`` holds is computed once. A batch that was cut off is made and written again as a whole.
    """
    spark = made.sparkSession
    if not is_finished(spark, target, batch):
        store = _folder(target, "made", batch)
        made.write.mode("overwrite").parquet(store)
        rows, rejects = split(spark.read.schema(made.schema).parquet(store))
        writer = rows.write.mode("overwrite").format(format)
        if format == "csv":
            writer = writer.options(**CSV_WRITE_OPTIONS).option("header", True)
        writer.save(_folder(target, "rows", batch))
        rejects.write.mode("overwrite").parquet(_folder(target, "rejects", batch))
        # plain values, so that an entry never depends on a later state of the folders
        entry = [(batch, rows.count(), rejects.count())]
        done = spark.createDataFrame(entry, "batch bigint, n_rows bigint, n_rejects bigint")
        done.coalesce(1).write.mode("overwrite").parquet(_folder(target, "ledger", batch))
    found = _read(spark, _folder(target, "ledger", batch)).first()
    return found["n_rows"], found["n_rejects"]


def read_rows(spark: SparkSession, target: str, format: str = "csv") -> DataFrame | None:
    """The rows of all finished batches, or None when there are none yet. CSV comes back as strings."""
    return _finished(spark, target, "rows", format)


def read_rejects(spark: SparkSession, target: str) -> DataFrame | None:
    """The rejects of all finished batches with the number of their batch, or None when there are none yet."""
    return _finished(spark, target, "rejects", "parquet", keep_batch=True)


def _finished(spark: SparkSession, target: str, part: str, format: str, keep_batch: bool = False) -> DataFrame | None:
    done, found = ledger(spark, target), _read(spark, _folder(target, part), format)
    if done is None or found is None:
        return None
    # one short row per batch
    entries, _ = broadcast_if_small(done.select(F.col("batch").alias("_batch")))
    rows = found.join(entries, F.col(BATCH) == F.col("_batch"), "left_semi")
    return rows.withColumnRenamed(BATCH, "batch") if keep_batch else rows.drop(BATCH)
