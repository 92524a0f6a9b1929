"""Seeded sampling, batching, prediction, evaluation and a text classifier for labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame, functions as F

from augspark.operators.skew import first_n_per_group, hashed_position, lowest_per_group, seeded_hash

# Fixed values
SUPPORT_ROWS = 200
DEFAULT_BATCH_SIZE = 30
DEFAULT_SHOTS = 10


def sample_shots(
    df: DataFrame,
    key: str,
    label: str = "label",
    shots: int = DEFAULT_SHOTS,
    seed: int = 144,
    dev_shots: int | None = None,
) -> DataFrame:
    """Keys of ``shots`` rows per label for training and as many others for validation.

    Only key and label are read; join back for the texts. Returns (key, label, split).
    """
    dev_shots = shots if dev_shots is None else dev_shots
    rows, digest, n = df.select(key, label), seeded_hash(F.col(key), seed), shots + dev_shots
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        chosen = first_n_per_group(rows, [label], [digest, F.col(key)], n)
    else:
        chosen = lowest_per_group(rows, [label], digest, key, n)
    split = F.when(F.col("rank") <= shots, "train").otherwise("validation")
    return chosen.select(key, label, split.alias("split"))


def sample_total(df: DataFrame, key: str, n: int = SUPPORT_ROWS, seed: int = 144) -> DataFrame:
    """Keys of ``n`` rows in seeded order."""
    return df.select(key).orderBy(seeded_hash(F.col(key), seed), key).limit(n)


def shuffled_batches(df: DataFrame, key: str, batch_size: int = DEFAULT_BATCH_SIZE, seed: int = 144) -> DataFrame:
    """Seeded shuffle of all rows, cut into batches: adds ``position`` and ``batch_id``."""
    placed = hashed_position(df, key, seed)
    return placed.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("bigint"))


def predict_class(class_scores: DataFrame) -> DataFrame:
    """Class of highest score per example, the first class on ties."""
    best = F.max_by("class_id", F.struct("class_score", -F.col("class_id")))
    return class_scores.groupBy("example").agg(best.alias("pred"))


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))


def evaluate(predictions: DataFrame, positive_label: int = 1, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Accuracy, RMSE, MAE, and precision, recall and F1 of the positive label (0 where undefined).

    weight: column with the number of rows that a row stands for; one without it.
    """
    label, pred = F.col("label"), F.col("pred")
    error = (pred - label).cast("double")
    told, true = pred == positive_label, label == positive_label
    rows = F.lit(1) if weight is None else F.col(weight)

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, rows).otherwise(0))

    def mean(value: Column) -> Column:
        return F.try_divide(F.sum(value * rows), F.sum(F.when(value.isNotNull(), rows)))

    counts = predictions.groupBy(*by).agg(
        mean((pred == label).cast("double")).alias("accuracy"),
        F.sqrt(mean(error * error)).alias("rmse"),
        mean(F.abs(error)).alias("mae"),
        count(told & true).alias("tp"),
        count(told).alias("told"),
        count(true).alias("true"),
    )
    # 2PR/(P+R) equals 2tp/(told+true), and both are 0 without hits
    return counts.select(
        *by,
        "accuracy",
        "rmse",
        "mae",
        _share(F.col("tp"), F.col("told")).alias("precision"),
        _share(F.col("tp"), F.col("true")).alias("recall"),
        _share(2 * F.col("tp"), F.col("told") + F.col("true")).alias("f1"),
    )


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch of highest validation accuracy, the later one on ties."""
    best = F.max_by(F.struct(*epochs.columns), F.struct("val_acc", "epoch"))
    return epochs.agg(best.alias("e")).select("e.*")


def fit_classifier(
    train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, max_iter: int = 20
) -> PipelineModel:
    """Bag-of-words logistic regression, standing in for training a language model.

    It is meant for the few-shot split, but fits any table: Spark ML adds up gradients per partition.
    """
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+", toLowercase=False),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, predictionCol="_pred"),
    ]
    return Pipeline(stages=stages).fit(train)


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the predicted label ``pred``."""
    out = model.transform(df).withColumn("pred", F.col("_pred").cast("int"))
    return out.select(*df.columns, "pred")
