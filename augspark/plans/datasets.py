"""Augmentation of a whole dataset known to the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.operators.incremental import with_content_key
from augspark.plans.augment import augment_pending
from augspark.sources.catalog import DATASETS, Dataset, find_dataset
from augspark.sources.labeled import LAYOUTS, read_augmentation_input
from augspark.sources.sinks import write_labeled_csv

KEYS = ("content_key", "occurrence")


def augment_dataset(
    spark: SparkSession,
    root: str,
    name: str,
    step: Callable[[DataFrame], DataFrame],
    source: str = "test_no_aug",
    target: str = "test",
    datasets: dict[str, Dataset] = DATASETS,
) -> None:
    """Augment the rows of ``source`` and leave them where the dataset's readers expect split ``target``.

    Finished rows are kept with their keys in ``<target>_augmented``, so a repeated run only handles
    the rest. Rows with a missing label or text are left out.
    """
    known = find_dataset(name, datasets)
    folder = f"{root}/{known.folder or name}"
    rows = read_augmentation_input(spark, f"{folder}/{source}.csv").toDF("label", "text").dropna("any")
    # which of several identical rows is the first one does not matter
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    keyed = with_content_key(numbered, ["label", "text"], [F.col("_at")]).drop("_at")
    finished = f"{folder}/{target}_augmented"
    augment_pending(keyed, finished, KEYS, step)
    columns = LAYOUTS[known.layout]
    write_labeled_csv(spark.read.parquet(finished).select(*columns), f"{folder}/{target}.csv", known.header)
