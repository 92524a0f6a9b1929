"""Preparation of prompts for a few-shot classifier and the record of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.functions.subwords import Subwords
from augspark.functions.templates import render_template
from augspark.functions.text import truncate_tokens
from augspark.operators import lexicon as lx
from augspark.operators.fewshot import DEFAULT_BATCH_SIZE, DEFAULT_SHOTS, evaluate, sample_shots, sample_total
from augspark.operators.incremental import content_hash
from augspark.operators.word_weights import DEFAULT_RATE
from augspark.plans.label_words import classify_by_words
from augspark.plans.training import train_words, trained_lexicon
from augspark.sources.catalog import DATASETS, Dataset, dataset_lexicon, dataset_template, find_dataset, read_split
from augspark.session import scratch_path
from augspark.sources.sinks import run_record

MAX_TOKENS = 128


def classification_prompts(
    df: DataFrame, template: str, text: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: Subwords | None = None, special_tokens: int = 0
) -> DataFrame:
    """Add ``prompt``: the template filled with the first ``max_tokens`` words of the text.

    With a tokenizer the whole prompt has up to ``max_tokens`` sub-word tokens: what the template and the
    model's ``special_tokens`` leave is the text's budget, and only the text is cut.
    """
    if tokenizer is None:
        kept = truncate_tokens(F.col(text), max_tokens, "first")
    else:
        # the empty template's tokens are a number that does not depend on the row
        frame = tokenizer.count(render_template(template, {"text_a": F.lit("")}))
        kept = tokenizer.truncate(F.col(text), F.greatest(F.lit(0), F.lit(max_tokens - special_tokens) - frame))
    return df.withColumn("prompt", render_template(template, {"text_a": kept}))


def few_shot_prompts(
    train: DataFrame,
    test: DataFrame,
    template: str,
    key: str,
    shots: int = DEFAULT_SHOTS,
    seed: int = 144,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Prompts of the sampled train and validation rows and of all test rows: (key, label, split, prompt)."""
    # at most 2 * shots rows per label on the right
    sampled = train.join(sample_shots(train, key, shots=shots, seed=seed).drop("label"), key)
    rows = sampled.select(key, "label", "split", "text").unionByName(
        test.select(key, "label", F.lit("test").alias("split"), "text")
    )
    return classification_prompts(rows, template, max_tokens=max_tokens).drop("text")


def report(predictions: DataFrame, config: dict, positive_label: int = 1, weight: str | None = None) -> DataFrame:
    """Settings and metrics of a run over (label, pred) rows, each standing for ``weight`` rows."""
    return run_record(config, evaluate(predictions, positive_label, weight=weight))


def few_shot_run(
    spark: SparkSession,
    root: str,
    scripts_root: str,
    name: str,
    word_logit: Callable[[Column, Column], Column],
    kind: str = "manual",
    template_id: int = 0,
    shots: int = DEFAULT_SHOTS,
    seed: int = 144,
    calibrate: bool = True,
    refine: bool = False,
    epochs: int = 0,
    batch_size: int | None = DEFAULT_BATCH_SIZE,
    rate: float = DEFAULT_RATE,
    path: str | None = None,
    datasets: dict[str, Dataset] = DATASETS,
) -> DataFrame:
    """A whole classification run on a dataset of the catalog, as its run record.

    The dataset's files, the template and the label words come by name; prompts hold as many words of a
    text as the dataset allows. ``word_logit`` is the model: the score of a word (second column) for a
    prompt (first column). Calibration uses SUPPORT_ROWS rows of train as support; ``refine`` drops the
    dataset's share of the words whose prior is lowest. With ``epochs`` the words' weights are learned from
    ``shots`` rows per label, rated on as many others after each epoch, and those of the best epoch are
    used; the run is stored under ``path`` and goes on there if it is started again. Metrics are those of all
    rows of the test split; equal rows are scored once and count as often as they occur, and each may be
    sampled from train.
    """
    known = find_dataset(name, datasets)

    def keyed(split: str) -> DataFrame:
        rows = read_split(spark, root, name, split, datasets).groupBy("text", "label").agg(F.count("*").alias("copies"))
        return rows.select(content_hash(F.col("text"), F.col("label")).alias("example"), "text", "label", "copies")

    template = dataset_template(spark, scripts_root, name, kind, template_id, datasets)
    lexicon = dataset_lexicon(spark, scripts_root, name, kind, datasets)
    words = lexicon.select("word", "class_id").distinct()

    def prompted(rows: DataFrame) -> DataFrame:
        return classification_prompts(rows, template, max_tokens=known.max_tokens)

    def scored(rows: DataFrame) -> DataFrame:
        prompts = prompted(rows)
        every = F.explode(F.lit(sorted({r["word"] for r in listed}))).alias("word")  # the words of one lexicon file
        return prompts.select("example", "prompt", every).select("example", "word", word_logit(F.col("prompt"), F.col("word")).alias("logit"))

    listed = words.select("word").collect()
    train, test = keyed("train"), keyed("test")
    if calibrate or epochs:
        # every copy of a row counts as a row of train
        copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
        each = train.select(F.col("example").alias("content"), "label", copy)
        each = each.select(F.concat_ws(":", "content", "copy").alias("example"), "content", "label")
        contents = train.select(F.col("example").alias("content"), "text")
    support = None
    if calibrate:
        support = scored(each.join(sample_total(each, "example", seed=seed), "example").join(contents, "content"))
    refined = known.candidate_share if refine else None
    if epochs:
        shot = each.join(sample_shots(each, "example", shots=shots, seed=seed).select("example", "split"), "example").join(contents, "content")
        predicted = _trained_predictions(
            spark, shot, test, words, support, refined, prompted, word_logit, epochs, batch_size, rate, seed, path or scratch_path(spark, "run")
        )
    else:
        predicted = classify_by_words(scored(test), words, support, refine=refined)
    config = {"dataset": name, "template_id": template_id, "seed": seed, "shot": shots, "verbalizer": kind, "calibration": calibrate}
    if epochs:
        config["kptw_lr"] = rate
    return report(test.select("example", "label", "copies").join(predicted, "example"), config, weight="copies")


def _trained_predictions(
    spark: SparkSession,
    shot: DataFrame,
    test: DataFrame,
    words: DataFrame,
    support: DataFrame | None,
    refine: float | None,
    prompted: Callable[[DataFrame], DataFrame],
    word_logit: Callable[[Column, Column], Column],
    epochs: int,
    batch_size: int | None,
    rate: float,
    seed: int,
    path: str,
) -> DataFrame:
    """(example, pred) of the test rows by the word weights of the best epoch."""
    prior = lx.calibration_prior(support, words) if support is not None else None
    if refine is not None and support is not None:
        words = lx.refine_lexicon(words, lx.calibration_prior(support), refine)
    listed = sorted((r["class_id"], r["word"]) for r in words.collect())  # the words of one lexicon file
    lexicon = lx.LexiconArrays(tuple(range(len(listed))), tuple(c for c, _ in listed), (0.0,) * len(listed))
    ratio = None
    if prior is not None:
        known = {r["word"]: r["prior"] for r in prior.collect()}
        ratio = F.lit([float(known[w]) for _, w in listed]).cast("array<double>")

    def with_logits(rows: DataFrame) -> DataFrame:
        logits = F.array(*[word_logit(F.col("prompt"), F.lit(w)) for _, w in listed])
        return prompted(rows).withColumn("logits", logits)

    tuned, rated = (with_logits(shot.where(F.col("split") == s)) for s in ("train", "validation"))
    train_words(tuned, rated, lexicon, path, epochs=epochs, batch_size=batch_size, rate=rate, seed=seed, prior=ratio)
    best = trained_lexicon(spark, path, lexicon)
    scores = lx.class_score_arrays(with_logits(test), best, prior=ratio, temperature=1.0)
    return scores.select("example", lx.predicted_class(F.col("class_scores")).alias("pred"))
