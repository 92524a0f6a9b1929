"""Learned weights of label words: loss and gradient over tables of word scores, and steps along it."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.scoring import dot, let, softmax
from augspark.operators.lexicon import LexiconArrays, word_logs

# Rate and limit of the steps, and the constants of their moments
DEFAULT_RATE = 0.06
MAX_NORM = 1.0
FIRST_DECAY, SECOND_DECAY, EPSILON = 0.9, 0.999, 1e-6


@dataclass(frozen=True)
class WeightState:
    """The weight of every word of a lexicon, with the moments of its gradients and the number of steps so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def of(cls, lexicon: LexiconArrays) -> WeightState:
        weights = np.array(lexicon.weights, float)
        return cls(weights, np.zeros(len(weights)), np.zeros(len(weights)))

    def stepped(self, gradient: np.ndarray, rate: float = DEFAULT_RATE, max_norm: float | None = MAX_NORM) -> WeightState:
        """One step against a mean gradient, whose length is cut to ``max_norm``; step sizes adapt to past gradients."""
        norm = float(np.sqrt((gradient * gradient).sum()))
        if max_norm is not None and norm > max_norm:
            gradient = gradient * (max_norm / norm)
        t = self.steps + 1
        first = FIRST_DECAY * self.first + (1 - FIRST_DECAY) * gradient
        second = SECOND_DECAY * self.second + (1 - SECOND_DECAY) * gradient * gradient
        size = rate * np.sqrt(1 - SECOND_DECAY**t) / (1 - FIRST_DECAY**t)
        return WeightState(self.weights - size * first / (np.sqrt(second) + EPSILON), first, second, t)

    def lexicon(self, lexicon: LexiconArrays) -> LexiconArrays:
        """The lexicon with these weights."""
        return replace(lexicon, weights=tuple(self.weights.tolist()))


def shares(lexicon: LexiconArrays, weights: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Each word's part of its class: softmax of ``temperature * weight`` over the words of the class."""
    classes = np.array(lexicon.classes)
    out = np.zeros(len(classes))
    for c in np.unique(classes):
        own = classes == c
        e = np.exp(temperature * (weights[own] - weights[own].max()))
        out[own] = e / e.sum()
    return out


def _double_array(values: np.ndarray) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def class_scores_of(log_p: Column, lexicon: LexiconArrays, share: np.ndarray) -> Column:
    """Score of each class from the log probabilities of the lexicon's words, as an array."""
    classes = np.array(lexicon.classes)
    many = int(classes.max()) + 1
    if len(np.unique(classes)) < many:
        raise ValueError("every class needs a label word")
    # a row of shares per class, 0 for the words of other classes
    rows = [_double_array(np.where(classes == c, share, 0.0)) for c in range(many)]
    return let(log_p, lambda logs: F.array(*[dot(logs, row) for row in rows]))


def loss_and_gradient(rows: DataFrame, lexicon: LexiconArrays, weights: np.ndarray, temperature: float = 1.0, label: str = "label") -> DataFrame:
    """One row with n, loss and gradient, or none without rows: sums of the cross entropy of ``label`` and of its derivatives by weight.

    rows: ``log_p`` (see :func:`word_logs`) and the class as ``label``; rows with another label count for
    nothing. Sums are added up per task, so one array of the lexicon's length is all that travels per task.
    """
    share = shares(lexicon, weights, temperature)
    classes = F.lit([int(c) for c in lexicon.classes]).cast("array<int>")
    many = max(lexicon.classes) + 1
    scored = rows.where(F.col(label).between(0, many - 1)).select(F.col(label).cast("int").alias("y"), "log_p")
    scored = scored.withColumn("s", class_scores_of(F.col("log_p"), lexicon, share))
    top = F.array_max("s")
    total = F.aggregate(F.transform("s", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    loss = F.ln(total) + top - F.element_at("s", F.col("y") + 1)
    off = F.transform(softmax(F.col("s")), lambda q, c: q - F.when(c == F.col("y"), 1.0).otherwise(0.0))

    def derivative(off: Column) -> Column:
        places = F.transform(classes, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        share_of = _double_array(temperature * share)
        return F.transform(
            places,
            lambda p: F.element_at(off, p["c"] + 1)
            * F.element_at(share_of, p["i"] + 1)
            * (F.element_at("log_p", p["i"] + 1) - F.element_at("s", p["c"] + 1)),
        )

    parts = scored.select(loss.alias("loss"), let(off, derivative).alias("g"))
    # grouped by a constant, since vectors of no rows have no sum
    sums = parts.groupBy(F.lit(0).alias("_")).agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("g")).alias("gradient"))
    return sums.drop("_")


def fit_step(rows: DataFrame, lexicon: LexiconArrays, state: WeightState, rate: float = DEFAULT_RATE, temperature: float = 1.0) -> tuple[WeightState, float, int]:
    """The state after one step over the rows, with the rows' summed loss before it and their number."""
    found = loss_and_gradient(rows, lexicon, state.weights, temperature).first()
    if found is None:
        return state, 0.0, 0
    return state.stepped(found["gradient"].toArray() / found["n"], rate), found["loss"], found["n"]


__all__ = ["WeightState", "class_scores_of", "fit_step", "loss_and_gradient", "shares", "word_logs"]
