"""Readers of label-word files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD_SETS_TYPE = "array<map<string,array<string>>>"
MAX_FILE_BYTES = 16 << 20
_EDGE_BLANKS = r"(?m)^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (lexicon, content) per file. Lexicon files hold some thousand words; huge ones are refused."""
    files = spark.read.format("binaryFile").load(path)
    refused = F.raise_error(F.concat(F.lit("too large for a lexicon: "), F.col("path"))).cast("binary")
    content = F.when(F.col("length") > MAX_FILE_BYTES, refused).otherwise(F.col("content"))
    return files.select(F.col("path").alias("lexicon"), F.decode(content, "utf-8").alias("content"))


def parse_lexicon(files: DataFrame, name: str = "lexicon", content: str = "content") -> DataFrame:
    """(lexicon, choice, class_id, word_pos, word) from lexicon texts.

    Line i lists the words of class i, separated by commas. Blank lines separate alternative sets
    (``choice``) within a file.
    """
    lines = F.regexp_replace(F.regexp_replace(content, _EDGE_BLANKS, ""), r"\A\n+|\n+\z", "")
    return (
        files.select(name, F.posexplode(F.split(lines, r"\n\n+")).alias("choice", "_set"))
        .where(F.col("_set") != "")
        .select(name, "choice", F.posexplode(F.split("_set", "\n")).alias("class_id", "_line"))
        .select(name, "choice", "class_id", F.posexplode(F.split("_line", ",")).alias("word_pos", "word"))
    )


def read_lexicon(
    spark: SparkSession, path: str, classes: Sequence[str] | None = None, choice: int | None = 0
) -> DataFrame:
    """Label words of one or more lexicon files; ``choice=None`` keeps all alternative sets.

    With ``classes`` given, a set with another number of lines than classes is an error.
    """
    words = parse_lexicon(whole_files(spark, path))
    if choice is not None:
        check_choice(words, choice)
        words = words.where(F.col("choice") == choice)
    if classes is not None:
        check_class_count(words, len(classes))
    return words


def check_choice(words: DataFrame, choice: int) -> None:
    """Every lexicon has a set of this number."""
    most = words.groupBy("lexicon").agg(F.max("choice").alias("last"))
    short = most.where(F.col("last") < choice).first()
    if short or choice < 0 or most.first() is None:
        found = f"{short['lexicon']} has sets up to {short['last']}" if short else "no words found"
        raise ValueError(f"no label-word set {choice}: {found}")


def check_class_count(words: DataFrame, expected: int) -> None:
    wrong = (
        words.groupBy("lexicon", "choice")
        .agg(F.count_distinct("class_id").alias("found"))
        .where(F.col("found") != expected)
        .first()
    )
    if wrong:
        raise ValueError(f"{wrong['lexicon']} has words for {wrong['found']} classes, expected {expected}")


def parse_word_sets(files: DataFrame, name: str = "lexicon", content: str = "content") -> DataFrame:
    """(lexicon, choice, class_name, word_pos, word) from JSON arrays of class -> word list."""
    sets = F.from_json(content, WORD_SETS_TYPE, {"mode": "FAILFAST"})
    return (
        files.select(name, F.posexplode(sets).alias("choice", "_classes"))
        .select(name, "choice", F.explode("_classes").alias("class_name", "_words"))
        .select(name, "choice", "class_name", F.posexplode("_words").alias("word_pos", "word"))
    )


def read_word_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_sets(whole_files(spark, path))
