"""Datasets known by name: layout, class names, split files, templates and label words."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.functions.templates import read_template
from augspark.sources.labeled import read_labeled
from augspark.sources.lexicons import read_lexicon


@dataclass(frozen=True)
class Dataset:
    """How a dataset's files are laid out. ``classes`` are the class names in label order.

    ``lexicon_classes`` are the classes in the order of the lines of the label-word files, which may
    differ from the label order.
    """

    classes: tuple[str, ...]
    layout: str = "label_text"
    header: bool = False
    named_labels: bool = False
    mask_users: bool = False
    splits: tuple[str, ...] = ("train", "test")
    folder: str = ""
    scripts: str = "Cyberbullying/tweets"
    lexicon_classes: tuple[str, ...] = ("cyberbullying", "not_cyberbullying")
    max_tokens: int = 128
    candidate_share: float = 0.5
    options: dict = field(default_factory=dict)


# Class names in label order and file layout of the known datasets
DATASETS = {
    "tweets": Dataset(
        ("cyberbullying", "not_cyberbullying"),
        layout="text_label",
        header=True,
        named_labels=True,
        splits=("train", "test", "validation"),
        folder="Cyberbullying/tweets",
    ),
    "ToxiGen": Dataset(("not_cyberbullying", "cyberbullying"), folder="Cyberbullying/ToxiGen"),
    "LHd": Dataset(("not_cyberbullying", "cyberbullying"), folder="Cyberbullying/LHd"),
    "weibo": Dataset(
        ("非暴力", "暴力"),
        mask_users=True,
        folder="Cyberbullying/weibo",
        scripts="Cyberbullying/weibo",
        lexicon_classes=("暴力", "非暴力"),
    ),
}


def find_dataset(name: str, datasets: dict[str, Dataset] = DATASETS) -> Dataset:
    if name not in datasets:
        raise ValueError(f"unknown dataset {name!r}, known are {', '.join(datasets)}")
    return datasets[name]


def read_split(
    spark: SparkSession, root: str, name: str, split: str, datasets: dict[str, Dataset] = DATASETS
) -> DataFrame:
    """One split of a dataset as (dataset, split, text, label)."""
    known = find_dataset(name, datasets)
    if split not in known.splits:
        raise ValueError(f"dataset {name!r} has no split {split!r}")
    rows = read_labeled(
        spark,
        f"{root}/{known.folder or name}/{split}.csv",
        known.layout,
        known.header,
        known.classes if known.named_labels else None,
        known.mask_users,
        **known.options,
    )
    return rows.select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), "text", "label")


def read_dataset(
    spark: SparkSession, root: str, name: str, datasets: dict[str, Dataset] = DATASETS
) -> DataFrame:
    """All splits of a dataset."""
    splits = find_dataset(name, datasets).splits
    return reduce(DataFrame.unionByName, [read_split(spark, root, name, s, datasets) for s in splits])


def dataset_template(
    spark: SparkSession,
    scripts_root: str,
    name: str,
    kind: str,
    template_id: int,
    datasets: dict[str, Dataset] = DATASETS,
) -> str:
    """Template of a dataset by kind (manual, soft, mixed, ptuning) and line number."""
    known = find_dataset(name, datasets)
    return read_template(spark, f"{scripts_root}/{known.scripts}/{kind}_template.txt", template_id)


def dataset_lexicon(
    spark: SparkSession, scripts_root: str, name: str, kind: str, datasets: dict[str, Dataset] = DATASETS
) -> DataFrame:
    """Label words of a dataset by kind (manual, knowledgeable, kpt++, adj), classes in label order."""
    known = find_dataset(name, datasets)
    words = read_lexicon(spark, f"{scripts_root}/{known.scripts}/{kind}_verbalizer.txt", known.lexicon_classes)
    position = [known.classes.index(c) for c in known.lexicon_classes]
    return words.withColumn("class_id", F.element_at(F.lit(position), F.col("class_id") + 1))
