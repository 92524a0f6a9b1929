"""Row identity, progress and resuming by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.operators.skew import global_position, join_keys, row_numbers
from augspark.sources.sinks import CSV_READ_OPTIONS


def with_position(df: DataFrame, order: Sequence[Column], name: str = "guid") -> DataFrame:
    """Identify rows by their 0-based position in the given order."""
    return global_position(df, order, name)


def content_hash(*columns: Column) -> Column:
    """Digest of the row's content; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def with_content_key(
    df: DataFrame, columns: Sequence[str], order: Sequence[Column], limit: int | None = None
) -> DataFrame:
    """Identify rows by content digest and, among copies, by occurrence number (1-based)."""
    hashed = df.withColumn("content_key", content_hash(*map(F.col, columns)))
    return row_numbers(hashed, ["content_key"], order, "occurrence", limit)


def read_written(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame | None:
    """The output written so far, or None when there is none yet. CSV comes back as strings, without its headers."""
    if format == "csv":
        options = {**CSV_READ_OPTIONS, **options}
    try:
        return spark.read.format(format).options(**options).load(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def written_rows(spark: SparkSession, path: str, format: str = "parquet", **options) -> int:
    """Rows already written to an output; 0 when there is none yet."""
    written = read_written(spark, path, format, **options)
    return 0 if written is None else written.count()


def unprocessed(df: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Input rows whose key is not in the output yet."""
    return join_keys(df, written.select(*keys), keys, "left_anti")
