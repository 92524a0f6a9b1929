"""What Python workers hold of a batch."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augspark.functions import worker
from augspark.functions.subwords import CACHE_BYTES, Pieces, Subwords
from augspark.operators import generate as gen
from augspark.plans.text_queries import vocabulary_path

LETTERS = 20_000
# The batch itself has 60 million bytes; all its texts as Python values beside it would have as many again
HELD = 110 << 20


def tracing_factory():
    """Answers with the most Python memory that was held so far, and a text as long as the prompt."""
    import tracemalloc

    tracemalloc.start()
    return lambda prompts, sample_idx, **_: [f"{tracemalloc.get_traced_memory()[1]} {p[:-20]}" for p in prompts]


def tracing_scorer():
    import tracemalloc

    tracemalloc.start()
    return lambda prompts: [float(tracemalloc.get_traced_memory()[1]) for _ in prompts]


@pytest.fixture
def long_texts(spark):
    """One batch of 3,000 texts, 60 million characters."""
    return spark.range(0, 3000, 1, 1).select("id", F.concat(F.repeat(F.lit("x"), LETTERS), F.col("id").cast("string")).alias("text"))


def test_generation_holds_a_slice_of_a_batch(long_texts):
    made = gen.generate_text(long_texts, F.col("text"), tracing_factory)
    rows = made.select("id", F.split("generated", " ")[0].cast("bigint").alias("held"), F.length("generated").alias("n"), F.length("text").alias("m")).collect()
    assert [r["id"] for r in rows] == [*range(3000)] and all(r["n"] - len(str(r["held"])) == r["m"] - 19 for r in rows)
    assert max(r["held"] for r in rows) < HELD


def test_scoring_holds_a_slice_of_a_batch(long_texts):
    scores = gen.sample_scores(F.lit("opening"), F.array("text", F.lit(None).cast("string")), tracing_scorer)
    rows = long_texts.select("id", scores.alias("s")).collect()
    assert all(len(r["s"]) == 2 and r["s"][1] is None for r in rows)
    assert 0 < max(r["s"][0] for r in rows) < HELD


def test_slices_are_all_rows_in_order():
    column = pa.array([None if i % 7 == 0 else "a" * i for i in range(300)])
    assert [v for (v,) in worker.values_of(column)] == column.to_pylist()
    parts = [*worker.gathered(iter(["x" * (1 << 19)] * 5), len)]
    assert [len(p) for p in parts] == [2, 2, 1] and [*worker.gathered(iter([]), len)] == []


def test_sub_word_columns_share_a_worker(spark):
    tokenizer, text = Subwords(spark, vocabulary_path()), F.col("text")
    df = spark.createDataFrame([("some words of a text",)], "text string")
    out = df.select(tokenizer.count(text).alias("n"), tokenizer.truncate(text, 2, "first").alias("a"), tokenizer.truncate(text, 2, "last").alias("b"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert tuple(out.first()) == (5, "some words", " a text")


def test_long_words_are_not_remembered():
    pieces = Pieces(open(vocabulary_path(), encoding="utf-8").read())
    long = "a" * 4 * CACHE_BYTES
    assert pieces.count(f"{long} short {long}") == pieces.count(long) + pieces.count(" short") + pieces.count(f" {long}")
    assert all(len(w) <= CACHE_BYTES for w in pieces.known)


def tracing_failing_factory():
    """The first one's answers, but failing on prompts whose number is a multiple of seven."""
    import tracemalloc

    import pandas  # noqa: F401  pyarrow imports it at its first array, and it is no part of a batch

    tracemalloc.start()
    tracemalloc.reset_peak()

    def generate(prompts, sample_idx, **_):
        if any(int(p.rpartition(" ")[2]) % 7 == 0 for p in prompts):
            raise RuntimeError("model failed")
        return [f"{tracemalloc.get_traced_memory()[1]} {p}" for p in prompts]

    return generate


@pytest.mark.parametrize("on_error, lost", [("empty", 0), ("skip", None)])
def test_samples_of_a_failing_model_hold_a_slice_of_a_batch(spark, on_error, lost):
    # one batch of 6 million bytes, whose samples have 30 million characters
    texts = spark.range(0, 3000, 1, 1).select("id", F.concat(F.repeat(F.lit("x"), 2000), F.lit(" "), F.col("id").cast("string")).alias("text"))
    made = texts.select("id", gen.generated_samples(F.col("text"), tracing_failing_factory, on_error=on_error).alias("s"))
    parts = F.transform("s", lambda s: F.struct(s["sample_idx"].alias("i"), F.split(s["text"], " ")[0].alias("held"), F.length(s["text"]).alias("n"), s["error"].alias("error")))
    rows = made.select("id", parts.alias("s")).collect()
    assert [r["id"] for r in rows] == [*range(3000)] and all([s["i"] for s in r["s"]] == [*range(5)] for r in rows)
    failed = [s for r in rows for s in r["s"] if r["id"] % 7 == 0]
    whole = [(len(str(r["id"])) + 2002, s) for r in rows for s in r["s"] if r["id"] % 7]
    assert all((s["n"], s["error"]) == (lost, "model failed") for s in failed)
    assert all((s["n"] - len(s["held"]), s["error"]) == (n, None) for n, s in whole)
    assert max(int(s["held"]) for _, s in whole) < 20 << 20
