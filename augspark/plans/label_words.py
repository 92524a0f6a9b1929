"""Choice of label words, and classification through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from augspark.operators import lexicon as lx
from augspark.operators.fewshot import predict_class


def discriminative_words(
    tokens: DataFrame, anchors: DataFrame, labels: Sequence, n: int = lx.TOP_WORDS, label: str = "label"
) -> DataFrame:
    """Pool token vectors per word, compare with the anchors' mean vectors, keep the n most telling words."""
    words = lx.pool_words(tokens)
    scored = lx.score_words(words, lx.anchor_vectors(anchors, labels, label))
    return lx.top_words(scored, n)


def classify_by_words(
    word_scores: DataFrame,
    lexicon: DataFrame,
    support: DataFrame | None = None,
    weighted: bool = False,
    temperature: float = 1.0,
    refine: float | None = None,
) -> DataFrame:
    """Predicted class per example. A support set switches calibration on, ``refine`` drops rare words."""
    prior = None
    if support is not None:
        prior = lx.calibration_prior(support, lexicon)
        if refine is not None:
            lexicon = lx.refine_lexicon(lexicon, lx.calibration_prior(support), refine)
    probabilities = lx.word_probabilities(word_scores, lexicon)
    if prior is not None:
        probabilities = lx.calibrated_probabilities(probabilities, prior)
    scores = lx.weighted_class_scores(probabilities, temperature) if weighted else lx.class_scores(probabilities)
    return predict_class(scores)
