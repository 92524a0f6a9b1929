"""Writers: augmented rows, cleaned text files, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from augspark.functions.text import clean_commas

# Fixed format of a run record: key of each setting and label of each metric
RECORD_SETTINGS = (
    ("dataset", "dataset"), ("temp", "template_id"), ("seed", "seed"), ("shot", "shot"),
    ("verb", "verbalizer"), ("cali", "calibration"), ("filt", "filter"), ("maxsplit", "max_token_split"),
    ("kptw_lr", "kptw_lr"),
)
RECORD_METRICS = (
    ("Acc", "accuracy"), ("RMSE", "rmse"), ("MAE", "mae"), ("PRECISION", "precision"),
    ("RECALL", "recall"), ("F1 Score", "f1"),
)
RECORD_RULE = "=" * 20

# Shared by all CSV that the library writes: doubled quotes, white space kept, "" for an empty text and
# nothing for null
CSV_WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Reads appended output back as it was: each file has a header, texts may hold line breaks
CSV_READ_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "\x00",  # an empty field without quotes is null in any case
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "maxCharsPerColumn": -1,
}


def append_rows(df: DataFrame, path: str, format: str = "parquet", first: bool = False, header: bool = True) -> None:
    """Append a batch to the output; the first one replaces what was there. Each CSV file has its header."""
    writer = df.write.mode("overwrite" if first else "append")
    if format == "csv":
        writer.options(**CSV_WRITE_OPTIONS).option("header", header).csv(path)
    else:
        writer.format(format).save(path)


def write_labeled_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """Quoted CSV in the form that the labelled readers expect."""
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).option("header", header).csv(path)


def clean_text_file(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite a text file line by line with the commas cleaned.

    The lines of a large file end up in several files, so read the result as headerless.
    """
    lines = spark.read.text(source)
    lines.select(clean_commas(F.col("value")).alias("value")).write.mode("overwrite").text(target)


def run_record(config: dict, metrics: DataFrame) -> DataFrame:
    """Settings and metrics of one run as a typed one-row table."""
    return metrics.select(*[F.lit(v).alias(k) for k, v in config.items()], "*")


def record_text(record: DataFrame) -> DataFrame:
    """The record as text: settings on one line, metrics on the next."""
    known = [(key, c) for key, c in RECORD_SETTINGS if c in record.columns]
    settings = F.concat_ws("\t", *[F.concat(F.lit(f"{key} "), F.col(c).cast("string")) for key, c in known])
    scores = F.concat_ws("\t", *[F.concat(F.lit(f"{key}: "), F.col(c).cast("string")) for key, c in RECORD_METRICS])
    text = F.concat(F.lit(RECORD_RULE + "\n"), settings, F.lit("\t \n"), scores, F.lit("\n\n"))
    return record.select(text.alias("record"))


def write_run_record(config: dict, metrics: DataFrame, path: str) -> None:
    run_record(config, metrics).write.mode("append").parquet(path)


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Append one text line per row, such as the template that a run used."""
    lines.write.mode("append").text(path)
