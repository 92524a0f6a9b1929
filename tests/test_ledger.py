"""Outputs by batch: crashes at every point, replays, and repeated attempts of failing rows."""

import pytest
from pyspark.sql import functions as F

from augspark.plans import augment
from augspark.sources import ledger as lg
from augspark.streaming.augment import augment_files_once


def numbers(spark, *values):
    return spark.createDataFrame([(v, f'text, "{v}"\nmore ') for v in values], "id bigint, text string")


def failing(df, *bad):
    return df.withColumn("error", F.when(F.col("id").isin(*bad), "no luck"))


def crash_after_rows(made):
    """Rows can be written, rejects cannot."""
    rows, rejects = lg.split_by_error(made)
    return rows, rejects.unionByName(made.limit(1)).withColumn("error", F.raise_error(F.lit("died")).cast("string"))


def read(spark, target):
    rows = lg.read_rows(spark, target)
    return [] if rows is None else sorted((int(r["id"]), r["text"]) for r in rows.collect())


def test_a_batch_counts_once_it_is_in_the_ledger(spark, tmp_path):
    target = str(tmp_path / "out")
    assert lg.ledger(spark, target) is None and lg.read_rows(spark, target) is None and lg.read_rejects(spark, target) is None
    assert lg.next_batch(spark, target) == 0
    first = failing(numbers(spark, 1, 2, 3), 2)
    with pytest.raises(Exception, match="died"):
        lg.write_batch(first, target, 0, crash_after_rows)
    assert (tmp_path / "out" / "rows").exists() and read(spark, target) == [], "left rows are not read"
    assert lg.write_batch(first, target, 0) == (2, 1)
    # a replay of a finished batch does nothing, whatever it holds
    assert lg.write_batch(numbers(spark, 9), target, 0) == (2, 1)
    assert lg.write_batch(numbers(spark, 4), target, lg.next_batch(spark, target)) == (1, 0)
    assert read(spark, target) == [(v, f'text, "{v}"\nmore ') for v in (1, 3, 4)]
    assert [tuple(r) for r in lg.read_rejects(spark, target).select("id", "error", "batch").collect()] == [(2, "no luck", 0)]
    assert sorted(tuple(r) for r in lg.ledger(spark, target).select("batch", "n_rows", "n_rejects").collect()) == [(0, 2, 1), (1, 1, 0)]


def test_a_stream_replays_a_lost_batch(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    numbers(spark, *range(10)).repartition(4).write.parquet(source)

    def run(split, **settings):
        step = lambda batch: failing(batch, 3, 7)
        return augment_files_once(spark, source, "id bigint, text string", target, state, step, split, files_per_batch=1, **settings).awaitTermination()

    with pytest.raises(Exception, match="died"):
        run(crash_after_rows)
    assert read(spark, target) == []
    run(lg.split_by_error)
    run(lg.split_by_error)
    assert [i for i, _ in read(spark, target)] == [0, 1, 2, 4, 5, 6, 8, 9]
    assert sorted(r["id"] for r in lg.read_rejects(spark, target).collect()) == [3, 7]
    numbers(spark, 10, 11).write.mode("append").parquet(source)
    run(lg.split_by_error)
    assert [i for i, _ in read(spark, target)] == [0, 1, 2, 4, 5, 6, 8, 9, 10, 11]


def test_a_batch_that_the_stream_forgot_is_left_alone(spark, tmp_path):
    """The ledger has the batch, but the stream died before its own checkpoint did: it replays the batch."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    numbers(spark, 1, 2).coalesce(1).write.parquet(source)
    lg.write_batch(numbers(spark, 1, 2), target, 0)
    query = augment_files_once(spark, source, "id bigint, text string", target, str(tmp_path / "state"), lambda b: failing(b, 1))
    query.awaitTermination()
    assert [i for i, _ in read(spark, target)] == [1, 2] and lg.read_rejects(spark, target).count() == 0


def test_failing_rows_are_tried_again(spark, tmp_path):
    """Fails twice on some rows: all are written in the end, with two attempts on record."""
    target, calls = str(tmp_path / "out"), []

    def step(rest):
        calls.append(sorted(r["id"] for r in rest.select("id").collect()))
        return failing(rest, 2, 4) if len(calls) < 3 else failing(rest, -1)

    df = numbers(spark, 1, 2, 3, 4)
    assert augment.augment_with_retries(df, target, ["id"], step).collect() == []
    assert calls == [[1, 2, 3, 4], [2, 4], [2, 4]]
    assert [i for i, _ in read(spark, target)] == [1, 2, 3, 4]
    on_record = augment.attempts(spark, target, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in on_record] == [(2, 2, "no luck"), (4, 2, "no luck")]
    # nothing is left to do; new rows are
    augment.augment_with_retries(df, target, ["id"], step)
    assert len(calls) == 3
    augment.augment_with_retries(df.union(numbers(spark, 5)), target, ["id"], step)
    assert calls[3:] == [[5]]


def test_rows_are_given_up_with_their_error(spark, tmp_path):
    target = str(tmp_path / "out")
    df = numbers(spark, 1, 2, 3).union(numbers(spark, 2)).union(spark.createDataFrame([(None, "null key")], "id bigint, text string"))
    step = lambda rest: failing(rest, 2).withColumn("error", F.when(F.col("id").isNull(), "no key").otherwise(F.col("error")))

    def die(rest):
        raise RuntimeError("died")

    given_up = augment.augment_with_retries(df, target, ["id"], step, max_attempts=2)
    want = [(None, 2, "no key"), (2, 2, "no luck")]
    assert sorted((tuple(r) for r in given_up.collect()), key=repr, reverse=True) == sorted(want, key=repr, reverse=True)
    assert [tuple(r) for r in augment.augment_with_retries(df.where("id = 2"), target, ["id"], die, max_attempts=2).collect()] != []
    # more attempts take them up again
    again = augment.augment_with_retries(df, target, ["id"], lambda rest: failing(rest, -1), max_attempts=3)
    assert again.collect() == [] and lg.read_rows(spark, target).count() == 5


def test_retries_of_no_rows(spark, tmp_path):
    none = augment.augment_with_retries(numbers(spark, 1).where("false"), str(tmp_path / "out"), ["id"], lambda rest: rest)
    assert none.columns == ["id", "attempts", "error"] and none.collect() == []


def test_split_of_augmented_rows(spark):
    schema = "id int, text string, samples array<struct<sample_idx: int, text: string, error: string>>, scores array<double>"
    bad = [(0, None, "a"), (1, None, "b")]
    half = [(0, None, "a"), (1, "one.", None)]
    rows = [(1, "x", bad, [None, None]), (2, "x", half, [None, 2.0]), (3, None, [(0, None, "no prompt"), (1, None, "no prompt")], [None, None])]
    done, failed = augment.split_augmented()(spark.createDataFrame(rows, schema))
    assert [(r["id"], r["sample_idx"], r["text"]) for r in done.collect()] == [(2, 1, "x one.")]
    assert sorted((r["id"], r["error"]) for r in failed.collect()) == [(1, "a"), (3, "no prompt")]
