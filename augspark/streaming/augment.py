"""Continuous augmentation of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from augspark.sources.ledger import Split, split_by_error, write_batch


def augment_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame],
    format: str = "parquet",
    files_per_batch: int = 100,
    available_now: bool = True,
    interval: str = "1 minute",
    **options,
) -> StreamingQuery:
    """Run a map-only step over a growing folder and append the rows to ``target``.

    The checkpoint remembers finished files, so a restarted job goes on where it stopped and no row is
    written twice. ``available_now`` handles what is there and ends; otherwise the query keeps running.
    """
    files = (
        spark.readStream.format(format)
        .schema(schema)
        .options(**options)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )
    writer = step(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(target)


def augment_files_once(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame],
    split: Split = split_by_error,
    format: str = "parquet",
    written_format: str = "csv",
    files_per_batch: int = 100,
    available_now: bool = True,
    interval: str = "1 minute",
    **options,
) -> StreamingQuery:
    """Run a step over a growing folder; rows go to ``target`` as CSV (or ``written_format``), rejects beside them.

    Every batch of the stream is a batch of :mod:`augspark.sources.ledger` under the stream's own number. A
    batch that is replayed after a crash is written again as a whole, or left alone if the ledger has it, so
    :func:`read_rows` never sees a row twice. ``checkpoint`` and ``target`` belong together: a new checkpoint
    starts to count anew and needs a new target.
    """
    reader = spark.readStream.format(format).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(step(batch), target, number, split, written_format)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
