"""Label words: choosing discriminative words, and scoring classes from the scores of their words."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from augspark.functions.scoring import cosine, dot, let, normalised, softmax
from augspark.functions.subwords import Subwords, pooled
from augspark.operators.skew import broadcast_if_small, global_position
from augspark.session import cut_lineage

# Fixed values
TOP_WORDS = 30
LOG_EPSILON = 1e-15
CANDIDATE_SHARE = 0.5

# A lexicon is a hand-sized list; a larger table is not broadcast
MAX_LEXICON_WORDS = 100_000


# -- choosing label words -----------------------------------------------------------------------


def mean_vector(vec: str | Column) -> Column:
    """Element-wise mean of an array column, as an aggregate with partial sums."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(Summarizer.mean(array_to_vector(vec.cast("array<double>"))))


def pool_words(tokens: DataFrame, word: str = "word", vec: str = "vec", pos: str = "pos") -> DataFrame:
    """One mean vector per word over the vectors of its tokens, and the word's first position.

    Grouping by word also removes repeated words; a repeated word keeps its first place.
    """
    return tokens.groupBy(word).agg(mean_vector(vec).alias("vec"), F.min(pos).alias("pos"))


def anchor_vectors(anchors: DataFrame, labels: Sequence, label: str = "label", vec: str = "vec") -> list[Column]:
    """One scalar subquery per anchor label: the mean vector of its rows."""
    return [anchors.where(F.col(label) == F.lit(x)).agg(mean_vector(vec)).scalar() for x in labels]


def spread(values: Sequence[Column]) -> Column:
    """Sample standard deviation of a few columns."""
    if len(values) == 2:
        return F.abs(values[0] - values[1]) / F.sqrt(F.lit(2.0))
    mean = sum(values[1:], values[0]) / len(values)
    squares = [(v - mean) * (v - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / (len(values) - 1))


def score_words(words: DataFrame, anchors: Sequence[Column], vec: str = "vec") -> DataFrame:
    """Cosine of each word to every anchor and the spread of these cosines."""
    numbers = range(len(anchors))
    # subqueries may not stand inside higher-order functions, so they become columns first
    placed = words.withColumns({f"_anchor{i}": anchors[i] for i in numbers})
    own = F.col(vec).cast("array<double>")
    cosines = placed.withColumns({f"cos{i}": cosine(own, F.col(f"_anchor{i}")) for i in numbers})
    score = spread([F.col(f"cos{i}") for i in numbers])
    return cosines.withColumn("score", score).drop(*[f"_anchor{i}" for i in numbers])


def top_words(scored: DataFrame, n: int = TOP_WORDS, word: str = "word", pos: str = "pos") -> DataFrame:
    """The n words of largest score, earlier words first on ties."""
    return scored.orderBy(F.col("score").desc(), F.col(pos)).limit(n)


def word_line(chosen: DataFrame, word: str = "word", pos: str = "pos") -> DataFrame:
    """The chosen words joined by commas, in rank order, as one lexicon line."""
    place = F.struct((-F.col("score")).alias("s"), F.col(pos).alias("p"), F.col(word).cast("string").alias("w"))
    ranked = F.array_sort(F.collect_list(place))
    return chosen.agg(F.array_join(F.transform(ranked, lambda r: r["w"]), ",").alias("label_words"))


# -- scoring classes ----------------------------------------------------------------------------


def words_per_class(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("class_id").agg(F.count("*").alias("n_words"))


def word_probabilities(word_scores: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Softmax of each example's word scores over the words of the lexicon.

    (example, word) is unique, so an example's partition is bounded by the lexicon.
    """
    example = Window.partitionBy("example")
    return (
        word_scores.join(broadcast_if_small(lexicon, MAX_LEXICON_WORDS)[0], "word")
        .withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(example)))
        .withColumn("p", F.col("_e") / F.sum("_e").over(example))
        .drop("_e")
    )


def calibration_prior(support: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Prior of each word: softmax over the words of its mean score on a support set.

    Maximum and total are scalar subqueries over one row per word.
    """
    if lexicon is not None:
        words, _ = broadcast_if_small(lexicon.select("word").distinct(), MAX_LEXICON_WORDS)
        support = support.join(words, "word", "left_semi")
    means = support.groupBy("word").agg(F.avg("logit").alias("mean_logit"))
    shifted = means.select("word", F.exp(F.col("mean_logit") - means.agg(F.max("mean_logit")).scalar()).alias("e"))
    return shifted.select("word", (F.col("e") / shifted.agg(F.sum("e")).scalar()).alias("prior"))


def calibrated_probabilities(probabilities: DataFrame, prior: DataFrame) -> DataFrame:
    """Word probability divided by its prior, renormalised per example.

    The prior, a number per word of the lexicon, is taken once and sent along with the plan, so examples are
    not shuffled by the few words; more words than a lexicon may have are stored and joined.
    """
    example = Window.partitionBy("example")
    return (
        probabilities.join(_taken_once(prior.select("word", "prior")), "word")
        .withColumn("_q", F.col("p") / F.col("prior"))
        .withColumn("p", F.col("_q") / F.sum("_q").over(example))
        .drop("_q", "prior")
    )


def _taken_once(words: DataFrame) -> DataFrame:
    """A table of one short row per word, computed now."""
    rows = words.limit(MAX_LEXICON_WORDS + 1).collect()
    if len(rows) > MAX_LEXICON_WORDS:
        return cut_lineage(words)
    return F.broadcast(words.sparkSession.createDataFrame([tuple(r) for r in rows], words.schema))


def class_scores(probabilities: DataFrame) -> DataFrame:
    """Class score of each example: mean log probability of the class's words."""
    log_p = F.ln(F.col("p") + LOG_EPSILON)
    return probabilities.groupBy("example", "class_id").agg(F.avg(log_p).alias("class_score"))


def weighted_class_scores(probabilities: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Class score with weighted words: softmax of ``temperature * weight`` over the class's words."""
    # weights are small numbers set by hand, so the plain exponential does not overflow
    e = F.exp(F.col("weight") * temperature)
    log_p = F.ln(F.col("p") + LOG_EPSILON)
    return probabilities.groupBy("example", "class_id").agg((F.sum(e * log_p) / F.sum(e)).alias("class_score"))


def refine_lexicon(lexicon: DataFrame, prior: DataFrame, share: float = CANDIDATE_SHARE) -> DataFrame:
    """Drop the words whose prior is among the lowest ``share`` of the scored vocabulary."""
    placed = global_position(prior, [F.col("prior"), F.col("word")], "_place")
    cut = F.floor(placed.agg(F.count("*")).scalar() * F.lit(share))
    kept = placed.where(F.col("_place") >= cut).select("word")
    return lexicon.join(kept, "word", "left_semi")


# -- the same over rows of word scores ----------------------------------------------------------


@dataclass(frozen=True)
class LexiconArrays:
    """A lexicon on the driver: words as positions in a score array, with class and weight of each.

    A word of several pieces is a tuple of positions; ``pool`` tells which score of its pieces is its own.
    """

    words: tuple[int | tuple[int, ...], ...]
    classes: tuple[int, ...]
    weights: tuple[float, ...]
    pool: str = "first"


def split_words(lexicon: DataFrame, tokenizer: Subwords, max_token_split: int = -1, prefix: str = " ") -> DataFrame:
    """Add ``pieces``, the token ids of each word behind ``prefix``; words of more than ``max_token_split`` pieces go (-1: none)."""
    split = lexicon.withColumn("pieces", tokenizer.ids(F.concat(F.lit(prefix), F.col("word"))))
    return split if max_token_split < 0 else split.where(F.size("pieces") <= max_token_split)


def collect_lexicon(lexicon: DataFrame, pool: str = "first") -> LexiconArrays:
    """Bring a lexicon (word, class_id, optional weight) to the driver after checking its size.

    With a column ``pieces`` (positions of each word's pieces) these stand for the words, as they do in
    :func:`split_words`; a word without pieces cannot be scored and is left out.
    """
    weight = F.col("weight") if "weight" in lexicon.columns else F.lit(0.0)
    split = "pieces" in lexicon.columns
    pieces = F.col("pieces") if split else F.lit(None).cast("array<int>")
    rows = lexicon.where(F.size("pieces") > 0) if split else lexicon
    found = rows.select("class_id", "word", weight.alias("weight"), pieces.alias("pieces")).limit(MAX_LEXICON_WORDS + 1).collect()
    if len(found) > MAX_LEXICON_WORDS:
        raise ValueError(f"a lexicon holds at most {MAX_LEXICON_WORDS} words")
    rows = sorted((r["class_id"], r["word"], r["weight"], tuple(r["pieces"] or ())) for r in found)
    words = tuple(r[3] if split else r[1] for r in rows)
    return LexiconArrays(words, tuple(r[0] for r in rows), tuple(r[2] for r in rows), pool)


def lexicon_logits(logits: Column, lexicon: LexiconArrays) -> Column:
    """The scores of the lexicon's words, picked from the scores of the whole vocabulary."""
    if any(isinstance(w, tuple) for w in lexicon.words):
        pieces = F.array(*[F.lit(list(w) if isinstance(w, tuple) else [w]).cast("array<int>") for w in lexicon.words])

        def score(scores: Column, word: Column) -> Column:
            return let(F.transform(word, lambda i: F.element_at(scores, i + 1).cast("double")), lambda own: pooled(own, lexicon.pool))

        return let(logits, lambda scores: F.transform(pieces, lambda w: score(scores, w)))
    words = F.lit(list(lexicon.words)).cast("array<int>")
    return let(logits, lambda scores: F.transform(words, lambda w: F.element_at(scores, w + 1).cast("double")))


def array_prior(support: DataFrame, lexicon: LexiconArrays, logits: str = "logits") -> Column:
    """Calibration prior of the lexicon's words as a scalar subquery: softmax of their mean scores."""
    means = support.agg(mean_vector(lexicon_logits(F.col(logits), lexicon)).alias("m"))
    return means.select(softmax(F.col("m"))).scalar()


def word_logs(lexicon: LexiconArrays, calibrated: bool = False, logits: str = "logits") -> Column:
    """Log probabilities of the lexicon's words; calibrated: divided by the column ``_prior`` and normalised again."""
    p = softmax(lexicon_logits(F.col(logits), lexicon))
    if calibrated:
        p = normalised(F.zip_with(p, F.col("_prior"), lambda a, b: a / b))
    return F.transform(p, lambda x: F.ln(x + LOG_EPSILON))


def class_score_arrays(
    df: DataFrame,
    lexicon: LexiconArrays,
    prior: Column | None = None,
    temperature: float | None = None,
    logits: str = "logits",
) -> DataFrame:
    """Add ``class_scores``, the score of each class, to rows that hold a score per vocabulary word.

    Works row by row: one model output is one row, so nothing is shuffled. ``temperature`` switches
    the word weights on.
    """
    log_p = word_logs(lexicon, prior is not None, logits)
    if prior is not None:
        # subqueries may not stand inside higher-order functions, so the prior becomes a column first
        df = df.withColumn("_prior", prior)

    def one_class(class_id: int) -> Column:
        places = [i for i, c in enumerate(lexicon.classes) if c == class_id]
        raw = [1.0 if temperature is None else math.exp(temperature * lexicon.weights[i]) for i in places]
        weights = [w / sum(raw) for w in raw]
        return F.struct(
            F.lit(places).cast("array<int>").alias("place"), F.lit(weights).cast("array<double>").alias("weight")
        )

    classes = F.array(*[one_class(c) for c in range(max(lexicon.classes) + 1)])

    def score(logs: Column, words: Column) -> Column:
        picked = F.transform(words["place"], lambda i: F.element_at(logs, i + 1))
        return F.when(F.size(words["place"]) > 0, dot(picked, words["weight"]))

    scores = let(log_p, lambda logs: F.transform(classes, lambda words: score(logs, words)))
    return df.withColumn("class_scores", scores).drop("_prior")


def predicted_class(class_scores: Column) -> Column:
    """Class of highest score in an array of class scores, the first one on ties."""
    return (F.array_position(class_scores, F.array_max(class_scores)) - 1).cast("int")
