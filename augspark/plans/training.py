"""Training of label-word weights by epochs, with a stored model and a rating per epoch, and resuming."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.operators.fewshot import DEFAULT_BATCH_SIZE, best_epoch, evaluate, shuffled_batches
from augspark.operators.incremental import read_written
from augspark.operators.lexicon import LexiconArrays, predicted_class
from augspark.operators.word_weights import DEFAULT_RATE, WeightState, class_scores_of, fit_step, shares, word_logs

# Fixed value
EPOCHS = 5

_EPOCH_SCHEMA = "epoch int, loss double, n bigint, val_acc double, rmse double, mae double"
_STATE_SCHEMA = "place int, word int, class_id int, weight double, first double, second double, steps int"


def train_words(
    train: DataFrame,
    validation: DataFrame,
    lexicon: LexiconArrays,
    path: str,
    key: str = "example",
    epochs: int = EPOCHS,
    batch_size: int | None = DEFAULT_BATCH_SIZE,
    rate: float = DEFAULT_RATE,
    temperature: float = 1.0,
    seed: int = 144,
    prior: Column | None = None,
    after_epoch: Callable[[int], None] | None = None,
) -> DataFrame:
    """Learn the weights of label words from rows of (key, label, logits); returns one row per epoch.

    An epoch takes a step per batch of its shuffled train rows (one step over all rows without a
    ``batch_size``), stores the weights and then the rating on the validation rows under ``path``. A run
    that died is started again with the same arguments: it goes on after the last rated epoch, with that
    epoch's weights and moments, and ends with the same table. Model outputs are turned into the
    lexicon's log probabilities once and stored. Rows whose label is not a class count for nothing.

    Only the weights, a number per word of the lexicon, are on the driver. Columns: epoch, loss (mean of
    the epoch's batches before their steps), n, val_acc, rmse, mae.
    """
    spark = train.sparkSession
    rows = _stored_logs(spark, path, train, validation, lexicon, key, prior)
    tuned, rated = rows.where(~F.col("held")), rows.where(F.col("held"))
    done = read_written(spark, f"{path}/ratings")
    first = 0 if done is None else done.agg(F.max("epoch")).first()[0] + 1
    state = WeightState.of(lexicon) if first == 0 else _read_state(spark, path, first - 1)
    for epoch in range(first, epochs):
        loss, n = 0.0, 0
        for batch in _batches(tuned, key, batch_size, seed + epoch):
            state, more, size = fit_step(batch, lexicon, state, rate, temperature)
            loss, n = loss + more, n + size
        _write_state(spark, path, epoch, lexicon, state)
        scores = class_scores_of(F.col("log_p"), lexicon, shares(lexicon, state.weights, temperature))
        rating = evaluate(rated.select("label", predicted_class(scores).alias("pred")))
        row = rating.select(
            F.lit(epoch).alias("epoch"),
            F.lit(loss / n if n else 0.0).alias("loss"),
            F.lit(n).cast("bigint").alias("n"),
            F.col("accuracy").alias("val_acc"),
            "rmse",
            "mae",
        )
        # the rating is what makes an epoch count: weights without one are written again
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/ratings/epoch_no={epoch}")
        if after_epoch:
            after_epoch(epoch)
    return epoch_table(spark, path)


def epoch_table(spark: SparkSession, path: str) -> DataFrame:
    """The rated epochs of a run."""
    found = read_written(spark, f"{path}/ratings")
    if found is None:
        return spark.createDataFrame([], _EPOCH_SCHEMA)
    return found.drop("epoch_no")


def trained_lexicon(spark: SparkSession, path: str, lexicon: LexiconArrays) -> LexiconArrays:
    """The lexicon with the weights of the epoch that :func:`best_epoch` chooses."""
    best = best_epoch(epoch_table(spark, path).where("val_acc is not null")).first()
    if best is None or best["epoch"] is None:
        raise ValueError(f"no rated epoch under {path}")
    return _read_state(spark, path, best["epoch"]).lexicon(lexicon)


def _stored_logs(spark: SparkSession, path: str, train: DataFrame, validation: DataFrame, lexicon: LexiconArrays, key: str, prior: Column | None) -> DataFrame:
    """Log probabilities of the train and validation rows, written once; a marker tells that they are complete."""
    where = f"{path}/examples"
    if read_written(spark, f"{path}/examples-written") is None:
        both = train.select(key, "label", "logits", F.lit(False).alias("held")).unionByName(
            validation.select(key, "label", "logits", F.lit(True).alias("held"))
        )
        if prior is not None:
            both = both.withColumn("_prior", prior)
        logs = both.select(key, "label", "held", word_logs(lexicon, prior is not None).alias("log_p"))
        logs.write.mode("overwrite").parquet(where)
        spark.read.parquet(where).groupBy("held").count().write.mode("overwrite").parquet(f"{path}/examples-written")
    return spark.read.parquet(where)


def _batches(rows: DataFrame, key: str, batch_size: int | None, seed: int):
    if batch_size is None:
        yield rows
        return
    batched = shuffled_batches(rows, key, batch_size, seed)
    count = -(-rows.count() // batch_size)
    for number in range(count):
        yield batched.where(F.col("batch_id") == number)


def _write_state(spark: SparkSession, path: str, epoch: int, lexicon: LexiconArrays, state: WeightState) -> None:
    # a word of several pieces goes by the first one; ``place`` tells words apart in any case
    words = [w[0] if isinstance(w, tuple) else w for w in lexicon.words]
    columns = zip(words, lexicon.classes, state.weights.tolist(), state.first.tolist(), state.second.tolist(), strict=True)
    rows = [(i, w, c, *numbers, state.steps) for i, (w, c, *numbers) in enumerate(columns)]
    spark.createDataFrame(rows, _STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights/epoch_no={epoch}")


def _read_state(spark: SparkSession, path: str, epoch: int) -> WeightState:
    # one row per word of the lexicon
    rows = spark.read.parquet(f"{path}/weights/epoch_no={epoch}").orderBy("place").collect()
    columns = [np.array([r[c] for r in rows], float) for c in ("weight", "first", "second")]
    return WeightState(*columns, steps=rows[0]["steps"])


def word_weights(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """(word, class_id, weight) after an epoch."""
    return spark.read.parquet(f"{path}/weights/epoch_no={epoch}").select("word", "class_id", "weight")
