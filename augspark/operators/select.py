"""Ranking of candidates and choice of one per input by the mode of their scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.scoring import (
    GRID_MARGIN,
    GRID_POINTS,
    INF,
    bandwidth,
    density_mode_arrow,
    is_valid_score,
    let,
    ordering_score,
)
from augspark.operators.skew import join_keys, row_numbers, split_by_group_size, stored_side

SMALL_GROUP = 1_000


def ranked_samples(samples: Column) -> Column:
    """Samples by ascending score, equal scores in generation order, invalid scores last."""
    keyed = F.transform(
        samples,
        lambda s: F.struct(ordering_score(s["score"]).alias("o"), s["sample_idx"].alias("i"), s.alias("s")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _distance(score: Column, mode: Column) -> Column:
    """Distance to the mode; the score itself where there is no mode, which selects the lowest one."""
    return F.when(is_valid_score(score), F.when(mode.isNull(), score).otherwise(F.abs(score - mode))).otherwise(INF)


def nearest_sample(samples: Column, mode: Column) -> Column:
    """The sample nearest to the mode, else the one of lowest score; the earlier one on ties."""

    def placed(s: Column, mode: Column) -> Column:
        return F.struct(_distance(s["score"], mode).alias("d"), s["sample_idx"].alias("i"), s.alias("s"))

    given = F.struct(samples.alias("samples"), mode.alias("mode"))
    return let(given, lambda g: F.array_min(F.transform(g["samples"], lambda s: placed(s, g["mode"]))))["s"]


def with_best_sample(df: DataFrame, samples: str = "samples", name: str = "best_sample") -> DataFrame:
    """Add the chosen sample of each row's candidate array. No shuffle, so it also works on streams."""
    scores = F.transform(samples, lambda s: s["score"])
    return (
        df.withColumn("_mode", density_mode_arrow(scores))
        .withColumn(name, nearest_sample(F.col(samples), F.col("_mode")))
        .drop("_mode")
    )


def input_results(df: DataFrame, input_text: str, samples: str = "samples") -> DataFrame:
    """Per input: its text, the ranked samples and the best text (empty when there are no samples)."""
    return (
        with_best_sample(df, samples)
        .withColumn(samples, ranked_samples(F.col(samples)))
        .withColumn("best_sample", F.coalesce(F.col("best_sample")["text"], F.lit("")))
        .withColumnRenamed(input_text, "input_text")
    )


def rank_candidates(candidates: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Rank per input over a table with one row per candidate."""
    return row_numbers(candidates, [key], [ordering_score(F.col(score)), F.col("sample_idx")], "rank")


def lowest_candidates(candidates: DataFrame, key: str, score: str = "score") -> DataFrame:
    """The candidate of lowest score of each input, the earlier one on ties."""
    others = [c for c in candidates.columns if c != key]
    lowest = F.min_by(F.struct(*others), F.struct(ordering_score(F.col(score)), "sample_idx"))
    return candidates.groupBy(key).agg(lowest.alias("c")).select(key, "c.*")


def score_moments(candidates: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Count, deviation, bounds and bandwidth of the valid scores of each input."""
    valid = F.when(is_valid_score(F.col(score)), F.col(score))
    return (
        candidates.groupBy(key)
        .agg(
            F.count(valid).alias("n_valid"),
            F.stddev_pop(valid).alias("sd"),
            F.min(valid).alias("low"),
            F.max(valid).alias("high"),
        )
        .withColumn("bandwidth", bandwidth(F.col("sd"), F.col("n_valid")))
    )


# Inputs whose sums a task holds at once: 500 doubles each
_HELD_SUMS = 2_000
_SCORE_BLOCK = 512


def _partial_densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and input: the densities that its scores add at the 500 grid points."""
    sums: dict[object, np.ndarray] = {}
    schema = None

    def rows() -> pa.RecordBatch:
        keys = pa.array(list(sums), schema.field(0).type)
        densities = pa.array(list(sums.values()), pa.list_(pa.float64()))
        sums.clear()
        return pa.record_batch([keys, densities], names=["key", "densities"])

    for batch in batches:
        schema = batch.schema
        codes = batch.column(0).dictionary_encode(null_encoding="encode")
        index = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(index, kind="stable")
        score, start, stop, width = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in range(1, 5))
        edges = np.flatnonzero(np.diff(index[order], prepend=-1, append=len(codes.dictionary)))
        for key, low, high in zip(codes.dictionary.to_pylist(), edges, edges[1:]):
            grid = start[low] + np.arange(GRID_POINTS) * (stop[low] - start[low]) / (GRID_POINTS - 1)
            held = sums.setdefault(key, np.zeros(GRID_POINTS))
            for at in range(low, high, _SCORE_BLOCK):
                u = (grid - score[at : min(at + _SCORE_BLOCK, high), None]) / width[low]
                held += np.exp(-0.5 * u * u).sum(axis=0)
        if len(sums) >= _HELD_SUMS:
            yield rows()
    if sums:
        yield rows()


def density_modes(
    candidates: DataFrame, key: str, score: str = "score", group_limit: int = SMALL_GROUP
) -> DataFrame:
    """Density mode of each input that has one.

    The scores of inputs with up to ``group_limit`` candidates meet as one array each; only larger inputs
    use :func:`summed_modes`. The modes are the same either way.
    """
    table = candidates.select(key, F.col(score).cast("double").alias("_score"))
    small, large = split_by_group_size(table, [key], group_limit)
    arrays = small.groupBy(key).agg(F.collect_list("_score").alias("_scores"))
    modes = arrays.select(key, density_mode_arrow(F.col("_scores")).alias("mode")).where(F.col("mode").isNotNull())
    return modes if large is None else modes.unionByName(summed_modes(large, key, "_score"))


def summed_modes(candidates: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Density modes from partial sums per grid point.

    Each task adds up its own candidates at the 500 grid points of an input before the shuffle, so an
    input with very many candidates costs one array per task.
    """
    moments = score_moments(candidates, key, score).where((F.col("n_valid") > 1) & (F.col("low") > -INF))
    bounds = stored_side(
        moments.select(
            key,
            (F.col("low") - GRID_MARGIN * F.col("sd")).alias("start"),
            (F.col("high") + GRID_MARGIN * F.col("sd")).alias("stop"),
            "bandwidth",
        )
    )
    valid = candidates.where(is_valid_score(F.col(score))).select(key, F.col(score).alias("_score"))
    placed = join_keys(valid, bounds, [key]).select(key, "_score", "start", "stop", "bandwidth")
    key_type = candidates.schema[key].dataType.simpleString()
    partial = placed.mapInArrow(_partial_densities, f"key {key_type}, densities array<double>")
    densities = partial.groupBy(F.col("key").alias(key)).agg(
        vector_to_array(Summarizer.sum(array_to_vector("densities"))).alias("_densities")
    )
    first_highest = F.array_position("_densities", F.array_max("_densities")) - 1
    grid = F.col("start") + first_highest * (F.col("stop") - F.col("start")) / (GRID_POINTS - 1)
    return join_keys(densities, bounds, [key]).select(key, grid.alias("mode"))


def best_candidates(
    candidates: DataFrame,
    key: str,
    score: str = "score",
    payload: Sequence[str] = (),
    group_limit: int = SMALL_GROUP,
) -> DataFrame:
    """The chosen candidate of each input, from a table with one row per (key, sample_idx).

    Inputs with up to ``group_limit`` candidates become arrays; larger ones use partial sums.
    """
    columns = ["sample_idx", "score", *payload]
    table = candidates.select(key, "sample_idx", F.col(score).cast("double").alias("score"), *payload)
    small, large = split_by_group_size(table, [key], group_limit)
    arrays = small.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("samples"))
    best = with_best_sample(arrays).select(key, "best_sample.*")
    if large is None:
        return best
    modes = stored_side(summed_modes(large, key))
    distance = _distance(F.col("score"), F.col("mode"))
    best_large = (
        join_keys(large, modes, [key], "left")
        .select(key, *columns, distance.alias("_d"))
        .groupBy(key)
        .agg(F.min_by(F.struct(*columns), F.struct("_d", "sample_idx")).alias("c"))
        .select(key, "c.*")
    )
    return best.unionByName(best_large)
