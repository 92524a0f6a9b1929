"""Readers of labelled text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.functions.text import class_index, int_label, replace_user_mask

LAYOUTS = {"label_text": ("label", "text"), "text_label": ("text", "label")}

# The strings that pandas.read_csv takes for missing by default
PANDAS_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cannot occur in text, so no field is read as null by the CSV parser itself
_NEVER = "\x00"


# Column that takes the text of records with another number of fields than expected
_BAD_RECORD = "_bad_record"


def read_csv_strings(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    header: bool = False,
    multiline: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Quoted CSV as strings: doubled quotes, line breaks inside quotes, empty fields kept as ''.

    ``multiline`` reads a file in one task, so large data should come in many files; files without
    line breaks inside fields can be split with ``multiline=False``. A byte-order mark is skipped. A
    record with another number of fields fails the job, or when not ``strict`` fills ``_bad_record``.
    """
    found = [*columns] if strict else [*columns, _BAD_RECORD]
    schema = ", ".join(f"{c} string" for c in found)
    fields = (
        spark.read.schema(schema)
        .option("header", header)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", _NEVER)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD_RECORD)
        .option("enforceSchema", True)
        .option("maxCharsPerColumn", -1)
        .csv(path)
    )
    # an empty field without quotes is null in any case
    return fields.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], *found[len(columns) :])


def missing_to_null(text: Column, na_values: Sequence[str] = PANDAS_MISSING) -> Column:
    return F.when(~text.isin(*na_values), text)


def read_labeled(
    spark: SparkSession,
    path: str | list[str],
    layout: str = "label_text",
    header: bool = False,
    classes: Sequence[str] | None = None,
    mask_users: bool = False,
    na_values: Sequence[str] | None = None,
    strict: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """Two-column labelled text as (text, label INT).

    ``classes`` decodes class names to their position. ``na_values`` turns such fields into null, as
    pandas does; without it all text is kept. When not ``strict``, a bad label or record does not fail
    the job: its label is null, and the text of a bad record is the whole record.
    """
    fields = read_csv_strings(spark, path, LAYOUTS[layout], header, multiline, strict)
    text, label = F.col("text"), F.col("label")
    if not strict:
        bad = F.col(_BAD_RECORD)
        text, label = F.coalesce(bad, text), F.when(bad.isNull(), label)
    if na_values is not None:
        text, label = missing_to_null(text, na_values), missing_to_null(label, na_values)
    if mask_users:
        text = replace_user_mask(text)
    decoded = class_index(label, classes, strict) if classes else int_label(label, strict)
    return fields.select(text.alias("text"), decoded.alias("label"))


def read_augmentation_input(
    spark: SparkSession, path: str | list[str], na_values: Sequence[str] = PANDAS_MISSING
) -> DataFrame:
    """Headerless class and text with missing values; the class is kept as it is."""
    fields = read_csv_strings(spark, path, ("cyberbullying_type", "tweet_text"))
    return fields.select(*[missing_to_null(F.col(c), na_values).alias(c) for c in fields.columns])


def rejects(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable label and rows without, from a tolerant read."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())
