"""Log-determinants by tiles and samples of many rows per label."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from augspark.functions.scoring import RIDGE
from augspark.operators import fewshot, skew, tiles, uncertainty as un


def vectors(spark, matrices):
    rows = [(s, x.tolist()) for s, m in matrices.items() for x in m]
    return spark.createDataFrame(rows, "sample_id string, vec array<double>").repartition(3)


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_determinants_of_several_matrices(spark, tile):
    rng = np.random.default_rng(3)
    matrices = {"a": rng.normal(0, 1, (9, 7)), "b": rng.normal(0, 1, (30, 12)), None: rng.normal(0, 1, (2, 1))}
    rows = vectors(spark, matrices).union(spark.createDataFrame([("a", None)], "sample_id string, vec array<double>"))
    made = tiles.product_tiles(rows, tile, 0.5)
    found = {r["sample_id"]: (r["d"], r["log_determinant"]) for r in tiles.log_determinants(made, tile).collect()}
    want = {}
    for s, m in matrices.items():
        z = m - m.mean(axis=1, keepdims=True)
        want[s] = (m.shape[1], np.linalg.slogdet(z.T @ z + 0.5 * np.eye(m.shape[1]))[1])
    assert {s: d for s, (d, _) in found.items()} == {s: d for s, (d, _) in want.items()}
    for s, (_, value) in want.items():
        assert found[s][1] == pytest.approx(value)
    assert tiles.log_determinants(made.where("false"), tile).collect() == []


def test_determinant_at_model_width(spark):
    """d = 2,048 in tiles of 256: no row holds more than three tiles."""
    rng = np.random.default_rng(8)
    m = rng.normal(0, 1, (300, 2048))
    found = tiles.log_determinants(tiles.product_tiles(vectors(spark, {"s": m}), 256, RIDGE), 256).first()
    z = m - m.mean(axis=1, keepdims=True)
    assert found["log_determinant"] == pytest.approx(np.linalg.slogdet(z.T @ z + RIDGE * np.eye(2048))[1], rel=1e-9)


def test_score_is_the_same_by_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(s, 3, p, rng.normal(0, 1, 6).tolist()) for s, n in ((1, 4), (2, 40), (3, 25)) for p in range(n)]
    hidden = spark.createDataFrame(rows, "sample_id int, layer int, pos int, vec array<double>")
    spans = spark.createDataFrame([(1, 0, 4), (2, 5, 40), (3, 24, 24)], "sample_id int, start int, end int")
    for given in (None, spans):
        scores = [
            {r["sample_id"]: r["svd_score"] for r in un.svd_score(hidden, given, 3, max_tokens=10, max_width=width, tile=4).collect()}
            for width in (100, 3)
        ]
        assert scores[0].keys() == scores[1].keys()
        assert scores[1] == pytest.approx(scores[0], nan_ok=True)


def test_many_shots_are_those_of_the_window(spark, monkeypatch):
    monkeypatch.setattr(skew, "HASH_DIGITS", 2)
    labels = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 2500, "b").when(F.col("id") % 50 == 1, None).otherwise("c")
    df = spark.range(4000).select(F.col("id").alias("key"), labels.alias("label")).repartition(5)
    n = 1200
    window = Window.partitionBy("label").orderBy(skew.seeded_hash(F.col("key"), 7), "key")
    want = df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    found = skew.lowest_per_group(df, ["label"], skew.seeded_hash(F.col("key"), 7), "key", n)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))
    shots = fewshot.sample_shots(df, "key", shots=700, dev_shots=500, seed=7)
    counts = {(r["label"], r["split"]): r["count"] for r in shots.groupBy("label", "split").count().collect()}
    assert counts["a", "train"] == 700 and counts["a", "validation"] == 500
    assert skew.lowest_per_group(df.where("false"), ["label"], F.md5(F.lit("x")), "key", 5).collect() == []
