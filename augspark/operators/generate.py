"""Fan-out of inputs into samples and the calls of a user-supplied text generator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.prompts import flat_prompt
from augspark.functions.text import extract_completion
from augspark.functions.worker import gathered, loaded, release_memory, values_of

# A generator gets a batch of prompts, the sample number of each prompt and the options below, and
# returns one text per prompt. A factory makes it once per Python worker, at its first prompt.
Generator = Callable[..., Sequence[str]]
Factory = Callable[[], Generator]

# The generation options used unless the caller gives others
DEFAULT_OPTIONS = {"temperature": 0.7, "top_p": 0.9, "max_new_tokens": 128}
DEFAULT_BATCH_SIZE = 8
DEFAULT_SAMPLES = 5

SAMPLES_TYPE = "array<struct<sample_idx:int,text:string,error:string>>"
_ARROW_SAMPLE = pa.struct([("sample_idx", pa.int32()), ("text", pa.string()), ("error", pa.string())])

ON_ERROR = ("raise", "empty", "skip")


def fan_out(df: DataFrame, n_samples: int = DEFAULT_SAMPLES) -> DataFrame:
    """One row per input and sample number."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))


def into_slots(df: DataFrame, key: str, value: Column, n_samples: int, name: str) -> DataFrame:
    """One row per key: an array with one slot per sample number, null where there is no value.

    Each slot is an aggregate of its own, so a key never holds more than ``n_samples`` values, and rows
    are combined before the shuffle. A repeated sample number, or one out of range, fails the job.
    """
    numbers = range(n_samples)
    slots = [F.first(F.when(F.col("sample_idx") == i, value), ignorenulls=True) for i in numbers]
    filled = [F.max(F.when(F.col("sample_idx") == i, 1).otherwise(0)) for i in numbers]
    grouped = df.groupBy(key).agg(
        F.array(*slots).alias("_slots"), (sum(filled[1:], filled[0]) == F.count("*")).alias("_whole")
    )
    message = F.concat(F.lit("repeated or unexpected sample number for "), F.col(key).cast("string"))
    return grouped.select(key, F.when(F.col("_whole"), F.col("_slots")).otherwise(F.raise_error(message)).alias(name))


def regroup(df: DataFrame, key: str, values: Sequence[str], n_samples: int = DEFAULT_SAMPLES) -> DataFrame:
    """Back to one row per input, with its samples as an array in order; (key, sample_idx) is unique."""
    grouped = into_slots(df, key, F.struct("sample_idx", *values), n_samples, "samples")
    return grouped.withColumn("samples", F.filter("samples", lambda s: s.isNotNull()))


def factory_token(factory: Factory) -> str:
    """Name of a factory with all that it carries along, the same wherever it is unpickled."""
    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def _checked(results: Sequence, prompts: list[str]) -> list:
    results = list(results)
    if len(results) != len(prompts):
        raise ValueError(f"got {len(results)} results for {len(prompts)} prompts")
    return results


def _call(generate: Generator, prompts: list[str], numbers: list[int], options: dict) -> list[str]:
    return _checked(generate(prompts, sample_idx=numbers, **options), prompts)


def _call_safely(
    generate: Generator, prompts: list[str], numbers: list[int], options: dict, on_error: str
) -> Iterator[tuple]:
    """(text, error) per prompt. A failing batch is repeated prompt by prompt to find the failing ones."""
    try:
        yield from ((text, None) for text in _call(generate, prompts, numbers, options))
        return
    except Exception as exc:
        if on_error == "raise":
            raise
        if len(prompts) == 1:
            yield ("" if on_error == "empty" else None, str(exc))
            return
    for prompt, number in zip(prompts, numbers):
        yield from _call_safely(generate, [prompt], [number], options, on_error)


def _samples_array(rows: list[list[tuple]], n_samples: int) -> pa.Array:
    """Rows of ``n_samples`` (text, error) as an array of SAMPLES_TYPE."""
    numbers = pa.array([*range(n_samples)] * len(rows), pa.int32())
    texts, errors = (pa.array([made[k] for row in rows for made in row], pa.string()) for k in range(2))
    offsets = pa.array([n_samples * i for i in range(len(rows) + 1)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([numbers, texts, errors], fields=list(_ARROW_SAMPLE)))


def generated_samples(
    prompt: Column,
    factory: Factory,
    n_samples: int = DEFAULT_SAMPLES,
    batch_size: int = DEFAULT_BATCH_SIZE,
    on_error: str = "raise",
    **options,
) -> Column:
    """Array of ``n_samples`` structs (sample_idx, text, error) for each prompt.

    Only the prompt column travels to the Python worker, once per input; the samples come back in one
    row, so generation, scoring and choice need no shuffle. ``on_error='empty'`` turns a failing prompt
    into an empty text, ``'skip'`` into a null text; both fill ``error``. A null prompt is not sent.

    The column is marked nondeterministic, so that no filter is moved below it and the model is called
    once per prompt. Store the result before using it twice.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    options = {**DEFAULT_OPTIONS, **options}
    token = factory_token(factory)

    @F.arrow_udf(SAMPLES_TYPE)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def results(column: pa.Array) -> Iterator[tuple]:
            asked = ((p, i) for (p,) in values_of(column) if p is not None for i in range(n_samples))
            while part := list(islice(asked, batch_size)):
                texts, numbers = map(list, zip(*part))
                yield from _call_safely(loaded(factory, token), texts, numbers, options, on_error)

        for column in columns:
            found = results(column)
            rows = (
                list(islice(found, n_samples)) if given else [(None, "no prompt")] * n_samples
                for given in column.is_valid().to_pylist()
            )
            # prompts are taken and samples given back slice by slice, whatever the size of the batch
            for part in gathered(rows, lambda row: sum(len(t or "") + len(e or "") for t, e in row) + 1):
                yield _samples_array(part, n_samples)
            release_memory()

    return run.asNondeterministic()(prompt)


def sample_scores(
    opening: Column, replies: Column, factory: Factory, batch_size: int = DEFAULT_BATCH_SIZE
) -> Column:
    """Score of each reply of an array, from a function that takes a batch of conversations.

    A conversation is ``opening`` followed by the reply; the opening is sent once per input. Where the
    function fails, even on a single conversation, the score is null and counts as failed. Null replies
    are not scored.
    """

    token = factory_token(factory)

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def scored(prompts: list[str]) -> list[float | None]:
            scorer = loaded(factory, token)
            try:
                return [float(x) for x in _checked(scorer(prompts), prompts)]
            except Exception:
                return [None] if len(prompts) == 1 else [x for p in prompts for x in scored([p])]

        for openings, arrays in columns:
            # two walks over the same rows: one for what is asked, one for where the scores go
            asked = (
                opening + t
                for opening, texts in values_of(openings, arrays)
                if opening is not None and texts is not None
                for t in texts
                if t is not None
            )
            parts = iter(lambda: list(islice(asked, batch_size)), [])
            found = (score for part in parts for score in scored(part))
            rows = [
                None if opening is None or texts is None else [None if t is None else next(found) for t in texts]
                for opening, texts in values_of(openings, arrays)
            ]
            yield pa.array(rows, type=pa.list_(pa.float64()))
            release_memory()

    return run.asNondeterministic()(opening, replies)


def generate_text(
    df: DataFrame, prompt: Column, factory: Factory, spread: int | None = None, **settings
) -> DataFrame:
    """One completion per row, in columns ``text`` and ``error``.

    ``spread`` redistributes the rows evenly first; use it when the input sits in few partitions.
    """
    if spread:
        df = df.repartition(spread)
    made = generated_samples(prompt, factory, n_samples=1, **settings)
    return (
        df.withColumn("_made", made)
        .withColumn("generated", F.col("_made")[0]["text"])
        .withColumn("error", F.col("_made")[0]["error"])
        .drop("_made")
    )


def store_with_rejects(generated: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Append generated rows to a store, so that the model runs once, and read the whole store back.

    Returns the accepted rows and the rejects, which are the rows with an error.
    """
    generated.write.mode("append").parquet(path)
    stored = generated.sparkSession.read.parquet(path)
    failed = F.col("error").isNotNull()
    return stored.where(~failed).drop("error"), stored.where(failed)


def prompt_and_generate(df: DataFrame, text: Column, factory: Factory, **settings) -> DataFrame:
    """Flat few-shot prompt, generation, and extraction of the completion."""
    out = generate_text(df, flat_prompt(text), factory, **settings)
    return out.withColumn("generated", extract_completion(F.col("generated")))
