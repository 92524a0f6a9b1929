"""Best-of-n augmentation: generate rewrites, score them, keep one per input, append it to the text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.prompts import append_reply, chat_messages, render_chat
from augspark.functions.scoring import let
from augspark.functions.text import drop_end_marker, join_rewrite, sentence_of, truncate_chars
from augspark.operators.generate import DEFAULT_SAMPLES, Factory, generated_samples, into_slots, sample_scores
from augspark.operators.incremental import read_written, unprocessed
from augspark.operators.select import with_best_sample
from augspark.sources.ledger import Split, next_batch, read_rejects, read_rows, split_by_error, write_batch
from augspark.sources.sinks import append_rows


def chat_prompt(lang: Column | str = "en") -> Callable[[Column], Column]:
    """Prompt builder: the default chat, left open for the reply."""
    return lambda text: render_chat(chat_messages(text, lang), open_reply=True)


def with_samples(
    df: DataFrame,
    factory: Factory,
    text: str = "text",
    n_samples: int = DEFAULT_SAMPLES,
    prompt: Callable[[Column], Column] | None = None,
    spread: int | None = None,
    **settings,
) -> DataFrame:
    """Add ``samples``: n generated rewrites of the truncated text, each cut to its first sentence.

    ``spread`` is a number of partitions to distribute the rows over first. Partitions are sized for
    data, and one of usual size can mean hours of model calls in a single task.
    """
    if spread:
        df = df.repartition(spread)
    build = prompt or chat_prompt()
    made = generated_samples(build(truncate_chars(F.col(text))), factory, n_samples=n_samples, **settings)

    def cut(s: Column) -> Column:
        # common parts of an expression are not shared inside a lambda, hence let
        sentence = let(drop_end_marker(s["text"]), sentence_of)
        return F.struct(s["sample_idx"].alias("sample_idx"), sentence.alias("text"), s["error"].alias("error"))

    return df.withColumn("_made", made).withColumn("samples", F.transform("_made", cut)).drop("_made")


def scoring_prompts(df: DataFrame, key: str, text: str = "text", lang: Column | str = "en") -> DataFrame:
    """One row per sample with the whole conversation, the input of a model that scores it."""
    messages = chat_messages(truncate_chars(F.col(text)), lang)
    exploded = df.select(key, messages.alias("_messages"), F.explode("samples").alias("s"))
    full = render_chat(append_reply(F.col("_messages"), F.col("s")["text"]))
    return exploded.select(key, F.col("s")["sample_idx"].alias("sample_idx"), full.alias("full_prompt"))


def score_slots(scores: DataFrame, key: str, n_samples: int, score: str = "svd_score") -> DataFrame:
    """Scores of an input as an array by sample number, null where one is missing."""
    return into_slots(scores, key, F.col(score), n_samples, "scores")


def choose_rewrite(
    df: DataFrame, text: str = "text", required: Sequence[str] | None = None, score: str | None = None
) -> DataFrame:
    """Pick one of ``samples`` by ``scores`` and append it to the text.

    Rows with a null in a ``required`` column, by default the text, are dropped: those without a text and
    those whose samples all failed. Nulls in other columns do no harm. ``score`` names a column for the
    score of the chosen sample.
    """

    def scored(s: Column, score: Column) -> Column:
        return F.struct(s["sample_idx"].alias("sample_idx"), s["text"].alias("text"), score.alias("score"))

    # both arrays are in the order of the sample numbers
    chosen = with_best_sample(df.withColumn("samples", F.zip_with("samples", "scores", scored)))
    if score:
        chosen = chosen.withColumn(score, F.col("best_sample")["score"])
    return (
        chosen.withColumn("sample_idx", F.col("best_sample")["sample_idx"])
        .withColumn(text, join_rewrite(F.col(text), F.col("best_sample")["text"]))
        .drop("samples", "scores", "best_sample")
        .dropna("any", subset=list(required) if required is not None else [text])
    )


def rejected_samples(df: DataFrame, key: str) -> DataFrame:
    """(key, sample_idx, error, all_failed) of every failed sample of rows with ``samples``."""
    failed = F.filter("samples", lambda s: s["error"].isNotNull())
    counted = df.select(key, "samples", failed.alias("_failed"))
    rows = counted.select(key, (F.size("_failed") == F.size("samples")).alias("all_failed"), F.explode("_failed").alias("_s"))
    return rows.select(key, F.col("_s")["sample_idx"].alias("sample_idx"), F.col("_s")["error"].alias("error"), "all_failed")


def augment_with_rejects(
    df: DataFrame,
    path: str,
    key: str,
    factory: Factory,
    score: Callable[[Column, Column], Column],
    text: str = "text",
    n_samples: int = DEFAULT_SAMPLES,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Whole step that goes on when the model fails: the augmented rows, and what failed.

    Samples and scores are appended to a store under ``path`` first, so the model runs once; both results
    are read from the whole store. See :func:`rejected_samples` for the second one.
    """
    settings.setdefault("on_error", "skip")
    made = with_samples(df, factory, text, n_samples, **settings)
    given = F.struct(F.col(text).alias("text"), F.col("samples").alias("samples"))
    scores = let(given, lambda g: F.transform(g["samples"], lambda s: score(g["text"], s["text"])))
    made.withColumn("scores", scores).write.mode("append").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return choose_rewrite(stored, text), rejected_samples(stored, key)


def augment_from_metrics(
    df: DataFrame, metrics: DataFrame, key: str, n_samples: int = DEFAULT_SAMPLES, text: str = "text", score: str = "svd_score"
) -> DataFrame:
    """Choice by scores computed from model outputs, for rows with ``samples``.

    metrics: one row per sample_id = key * n_samples + sample number, as :func:`calculate_metrics` gives
    them. A sample without a row has failed and is chosen only where all samples have.
    """
    numbered = metrics.select(
        F.floor(F.col("sample_id") / n_samples).alias(key), F.pmod("sample_id", F.lit(n_samples)).alias("sample_idx"), score
    )
    slots = score_slots(numbered, key, n_samples, score)
    ready = df.join(slots, key, "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
    whole = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: F.get("scores", i))
    return choose_rewrite(ready.withColumn("scores", whole), text)


def augment_best_of_n(
    df: DataFrame,
    factory: Factory,
    score: Callable[[Column, Column], Column],
    text: str = "text",
    n_samples: int = DEFAULT_SAMPLES,
    **settings,
) -> DataFrame:
    """Whole step with the score as a column of (input text, sample text). No shuffle; works on streams."""
    made = with_samples(df, factory, text, n_samples, **settings)
    given = F.struct(F.col(text).alias("text"), F.col("samples").alias("samples"))
    scores = let(given, lambda g: F.transform(g["samples"], lambda s: score(g["text"], s["text"])))
    return choose_rewrite(made.withColumn("scores", scores), text)


def augment_with_scorer(
    df: DataFrame,
    factory: Factory,
    scorer: Factory,
    text: str = "text",
    n_samples: int = DEFAULT_SAMPLES,
    lang: Column | str = "en",
    **settings,
) -> DataFrame:
    """Whole step with a second model call that scores the conversations. No shuffle; works on streams."""
    settings.setdefault("prompt", chat_prompt(lang))
    made = with_samples(df, factory, text, n_samples, **settings)
    opening = chat_prompt(lang)(truncate_chars(F.col(text)))
    scores = sample_scores(opening, F.transform("samples", lambda s: s["text"]), scorer)
    return choose_rewrite(made.withColumn("scores", scores), text)


def augment_with_scores(
    df: DataFrame,
    factory: Factory,
    scores: DataFrame,
    key: str,
    text: str = "text",
    n_samples: int = DEFAULT_SAMPLES,
    **settings,
) -> DataFrame:
    """Whole step with scores from a table (key, sample_idx, svd_score).

    The scores are joined before generation, so the samples themselves are never shuffled. This needs a
    generator that repeats itself; with a sampling one, store the output of :func:`with_samples`, score
    it, and pass it with its ``scores`` to :func:`choose_rewrite`.
    """
    slots = score_slots(scores, key, n_samples)
    ready = df.join(slots, key, "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
    padded = ready.withColumn(
        "scores", F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: F.get("scores", i))
    )
    return choose_rewrite(with_samples(padded, factory, text, n_samples, **settings), text)


def augment_pending(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    step: Callable[[DataFrame], DataFrame],
    format: str = "parquet",
    batches: int = 1,
) -> None:
    """Run a step over the rows whose key is not in the output yet, and append the result.

    A job that died is started again with the same arguments. The output keeps the key columns. With
    several ``batches`` the rows are cut by key hash and each batch is committed before the next one
    starts, so that less model time is lost; each batch scans the input again. CSV output is read back
    with the options that it is written with; its keys are compared as the input's types.
    """
    written = read_written(df.sparkSession, target, format)
    if written is not None:
        written = written.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys])
    rest = df if written is None else unprocessed(df, written, keys)
    for batch in range(batches):
        part = rest.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == batch) if batches > 1 else rest
        append_rows(step(part), target, format)


def split_augmented(text: str = "text") -> Split:
    """Splits rows with ``samples`` and ``scores`` into rewritten rows, and rows of which nothing came, with their first error."""

    def split(made: DataFrame) -> tuple[DataFrame, DataFrame]:
        no_sample = F.forall("samples", lambda s: s["error"].isNotNull())
        lost = F.col(text).isNull() | no_sample
        first = F.get(F.transform(F.filter("samples", lambda s: s["error"].isNotNull()), lambda s: s["error"]), F.lit(0))
        failed = made.where(lost).withColumn("error", F.coalesce(first, F.lit("no text")))
        return choose_rewrite(made.where(~lost), text), failed.drop("samples", "scores")

    return split


def attempts(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame | None:
    """Failed attempts per key so far: keys, attempts, and the error of the last one. None when there are none."""
    rejects = read_rejects(spark, target)
    if rejects is None:
        return None
    # a key fails once a round at most, also where several rows have it
    rounds = rejects.groupBy(*keys, "batch").agg(F.min("error").alias("error"))
    return rounds.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by("error", "batch").alias("error"))


def augment_with_retries(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    step: Callable[[DataFrame], DataFrame],
    split: Split = split_by_error,
    max_attempts: int = 3,
    format: str = "csv",
) -> DataFrame:
    """Run a step over the rows that are not written yet, again and again for those that fail; returns what is given up.

    Every round takes the rows whose key is neither written nor has failed ``max_attempts`` times, and is a
    batch of :mod:`augspark.sources.ledger`: a job that died is started again with the same arguments and
    repeats the round it died in. The output (:func:`read_rows`) and the rejects keep the key columns. The
    result has keys, attempts and the last error of each key that was given up; :func:`attempts` tells of all.
    """
    spark = df.sparkSession
    kinds = {k: df.schema[k].dataType for k in keys}

    def typed(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys]).distinct()

    def pending() -> DataFrame:
        rest, written, failed = df, read_rows(spark, target, format), attempts(spark, target, keys)
        if written is not None:
            rest = unprocessed(rest, typed(written), keys)
        if failed is not None:
            rest = unprocessed(rest, typed(failed.where(F.col("attempts") >= max_attempts)), keys)
        return rest

    for _ in range(max_attempts):
        rest = pending()
        if rest.isEmpty():
            break
        write_batch(step(rest), target, next_batch(spark, target), split, format)
    failed = attempts(spark, target, keys)
    if failed is None:
        return df.select(*keys, F.lit(0).cast("bigint").alias("attempts"), F.lit(None).cast("string").alias("error")).where(F.lit(False))
    lost, written = failed.where(F.col("attempts") >= max_attempts), read_rows(spark, target, format)
    return lost if written is None else unprocessed(lost, typed(written), keys)
