"""Hand-sized values, brute-force checks and odd inputs of the scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augspark.functions import scoring as sc
from augspark.operators import generate as gen, select as sel, uncertainty as un
from augspark.plans import sample_queries  # noqa: F401  (registers its queries)
from augspark.plans.registry import QUERIES

INF, NAN = float("inf"), float("nan")


def spans(spark, rows):
    return spark.createDataFrame(rows, "sample_id bigint, start int, end int")


def logits_table(spark, matrices):
    rows = [(i, p, [float(x) for x in row]) for i, m in enumerate(matrices) for p, row in enumerate(m)]
    return spark.createDataFrame(rows, "sample_id bigint, pos int, logits array<double>")


def hidden_table(spark, matrices, layer=0):
    rows = [(i, layer, p, [float(x) for x in row]) for i, m in enumerate(matrices) for p, row in enumerate(m)]
    return spark.createDataFrame(rows, "sample_id bigint, layer int, pos int, vec array<double>")


def by_sample(df, name):
    return {r["sample_id"]: r[name] for r in df.collect()}


def brute_svd(z, alpha=0.001):
    z = np.asarray(z, float).T  # features x tokens
    d = z.shape[0]
    sigma = z.T @ (np.eye(d) - np.ones((d, d)) / d) @ z + alpha * np.eye(z.shape[1])
    return np.log(np.linalg.svd(sigma, compute_uv=False)).mean()


def brute_pick(scores):
    """Index chosen by the rule, straight from its definition."""
    usable = [s for s in scores if s is not None and s == s and s != INF]
    ranked = sorted(range(len(scores)), key=lambda i: scores[i] if scores[i] in usable else INF)
    if len(usable) < 2:
        return ranked[0]
    x = np.array(usable)
    sd = x.std()
    bw = (4 * sd**5 / (3 * len(x))) ** 0.2 if sd > 1e-6 else 0.1
    bw = 0.1 if bw < 1e-6 else bw
    grid = np.linspace(x.min() - sd / 2, x.max() + sd / 2, 500)
    density = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1)
    peak = grid[density.argmax()]
    return min(range(len(scores)), key=lambda i: abs(scores[i] - peak) if scores[i] in usable else INF)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("top_k, expected", [(None, 0.3218346451), (2, 0.3188375724)])
def test_logit_entropy(spark, wide, top_k, expected):
    table = logits_table(spark, [[[2, 1, 0], [0, 0, 0]]])
    got = un.logit_entropy(table, spans(spark, [(0, 0, 2)]), top_k, wide=wide)
    assert by_sample(got, "logit_entropy")[0] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("fits", [True, False])
def test_entropy_of_odd_tokens(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(un, "fits_broadcast", lambda _: False)
    table = logits_table(spark, [[[2, 1, 0], [1, 1, 1]], [[0, -INF]], [[0, -2000.0]], [[1, 2]]])
    got = by_sample(un.logit_entropy(table, spans(spark, [(0, 5, 9), (1, 0, 1), (2, 0, 1), (9, 0, 1)])), "logit_entropy")
    assert set(got) == {0, 1, 2}
    assert all(math.isnan(v) for v in got.values())


def test_entropy_forms_agree(spark):
    rng = np.random.default_rng(1)
    table = logits_table(spark, [rng.normal(size=(6, 40)) * 3 for _ in range(5)])
    where = spans(spark, [(i, i % 3, 6) for i in range(5)])
    for top_k in (None, 7, 100):
        a = by_sample(un.logit_entropy(table, where, top_k), "logit_entropy")
        b = by_sample(un.logit_entropy(table, where, top_k, wide=True), "logit_entropy")
        assert a == pytest.approx(b, rel=1e-12)
    a = by_sample(un.logit_entropy(table, where, 8, normalize="sum"), "logit_entropy")
    b = by_sample(un.logit_entropy(table, where, 8), "logit_entropy")
    assert a == pytest.approx({k: v * 8 for k, v in b.items()})


def test_svd_score_golden(spark):
    got = un.svd_score(hidden_table(spark, [[[1, 2, 3], [2, 0, 1]]]), spans(spark, [(0, 0, 2)]), layer=0)
    assert by_sample(got, "svd_score")[0] == pytest.approx(0.5499725334, abs=1e-9)


@pytest.mark.parametrize("max_tokens", [4096, 5])
def test_svd_score_equals_svd(spark, max_tokens):
    """With a low limit the longer samples take the d x d path."""
    rng = np.random.default_rng(2)
    sizes = [1, 3, 9, 30]
    matrices = [rng.normal(size=(n, 4)) for n in sizes]
    where = [(i, n // 4, n) for i, n in enumerate(sizes)]
    table = hidden_table(spark, matrices).union(hidden_table(spark, [np.ones((2, 4))], layer=1)).repartition(3)
    got = by_sample(un.svd_score(table, spans(spark, where), layer=0, max_tokens=max_tokens), "svd_score")
    assert got == pytest.approx({i: brute_svd(m[s:e]) for (i, s, e), m in zip(where, matrices)}, rel=1e-6)


def test_all_tokens_and_text_ids(spark):
    """Without spans every token counts; ids may be strings."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(7, 3))
    table = hidden_table(spark, [z]).withColumn("sample_id", F.lit("s"))
    for limit in (100, 2):
        assert by_sample(un.svd_score(table, None, 0, limit), "svd_score") == pytest.approx({"s": brute_svd(z)}, rel=1e-6)
    logits = logits_table(spark, [[[2, 1, 0], [0, 0, 0]]])
    assert by_sample(un.logit_entropy(logits), "logit_entropy")[0] == pytest.approx(0.3218346451, abs=1e-9)
    diagonal = attention_table(spark).withColumn("own", F.col("row")[F.col("pos")]).drop("row")
    assert by_sample(un.attention_score(diagonal, None, 0), "attn_eig")[0] == pytest.approx(-2.9957322736, abs=1e-9)


def test_metrics_from_arrays(spark):
    rng = np.random.default_rng(8)
    z = [rng.normal(size=(t, 3)).tolist() for t in (5, 2, 9)]
    rows = [
        (0, 1, 5, [[2.0, 1.0, 0.0]] * 5, z[0], [[0.5, 0.25, 0.5, 1.0, 0.1]] * 2),
        (1, 2, 2, [[1.0, 1.0, 1.0]] * 2, z[1], [[0.5, 0.0]]),
        (2, 0, 9, [[0.0, 0.0]] * 9, z[2], None),
        (3, 0, 1, [[0.0, 0.0]], None, [[0.0]]),
    ]
    schema = "sample_id bigint, start int, end int, logits array<array<double>>, vectors array<array<float>>, own array<array<double>>"
    got = {r["sample_id"]: r for r in un.metrics_from_arrays(spark.createDataFrame(rows, schema)).collect()}
    assert got[0]["svd_score"] == pytest.approx(brute_svd(np.float32(z[0])[1:5]), rel=1e-6)
    assert got[0]["attn_eig"] == pytest.approx(2 * np.log([0.25, 0.5, 1.0, 0.1]).mean())
    p = np.exp([2, 1, 0]) / np.exp([2, 1, 0]).sum()
    assert got[0]["logit_entropy"] == pytest.approx(-(p * np.log(p)).mean())
    assert all(math.isnan(got[1][n]) for n in ("svd_score", "attn_eig", "logit_entropy"))
    assert got[2]["svd_score"] == pytest.approx(brute_svd(np.float32(z[2])), rel=1e-6)
    assert (got[2]["attn_eig"], got[3]["svd_score"], got[3]["attn_eig"]) == (0.0, 0.0, -INF)
    assert got[2]["logit_entropy"] == pytest.approx(np.log(2) / 2)


def test_metrics_of_samples_with_missing_tokens(spark):
    """A null in an array is a token without a row, wherever it stands; samples of other lengths share the batch."""
    rng = np.random.default_rng(12)
    found = [(0, 0, 1, 2, 3), (1, 1, 2), (2, 0), (3, 0, 3), (4, 1)]
    z = {(i, p): rng.normal(size=5).tolist() for i, *positions in found for p in positions}
    own = {k: abs(v[0]) / 9 for k, v in z.items()}
    by_token = lambda values: [[values.get((i, p)) for p in range(4)] for i, *_ in found]
    rows = [(i, 1, 4, v, v, [o]) for i, (v, o) in enumerate(zip(by_token(z), by_token(own)))]
    schema = "sample_id bigint, start int, end int, logits array<array<double>>, vectors array<array<double>>, own array<array<double>>"
    names = ("sample_id", "svd_score", "attn_eig", "logit_entropy")
    samples = spark.createDataFrame(rows, schema).coalesce(1)
    got = {r["sample_id"]: tuple(r[n] for n in names) for r in un.metrics_from_arrays(samples, top_k=3).collect()}
    logits = spark.createDataFrame([(*k, v) for k, v in z.items()], "sample_id bigint, pos int, logits array<double>")
    hidden = logits.withColumnRenamed("logits", "vec").withColumn("layer", F.lit(0))
    attention = spark.createDataFrame([(i, 0, 0, p, x) for (i, p), x in own.items()], "sample_id bigint, layer int, head int, pos int, own double")
    wanted = un.calculate_metrics(spans(spark, [(i, 1, 4) for i in range(5)]), logits, hidden, attention, 0, top_k=3)
    for r in wanted.collect():
        assert got[r["sample_id"]] == pytest.approx(tuple(r[n] for n in names), nan_ok=True)
    assert got[1][1] == pytest.approx(brute_svd(np.array([z[1, 1], z[1, 2]]))) and math.isnan(got[2][1])


def test_metrics_query_with_a_part_of_a_sample(spark, tmp_path):
    """Vectors that do not fill the last sample: the scores are those of the tables."""
    rng = np.random.default_rng(13)
    for n in (9, 10, 11, 14):
        rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
        df.write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got, wanted = ({r[0]: tuple(r) for r in QUERIES[q](spark, f"{tmp_path}/{n}").collect()} for q in ("metrics_from_arrays", "calculate_metrics"))
        assert len(got) == len(wanted) == -(-n // 4)
        for i, scores in wanted.items():
            assert got[i] == pytest.approx(scores, nan_ok=True)


def attention_table(spark):
    # the diagonals are .5 .25 and .1 .2 for sample 0; sample 1 attends nowhere at position 0
    rows = [(0, 0, 0, 0, [0.5, 0.0]), (0, 0, 0, 1, [0.75, 0.25]), (0, 0, 1, 0, [0.1, 0.0]), (0, 0, 1, 1, [0.8, 0.2]),
            (1, 0, 0, 0, [0.0, 0.0]), (1, 0, 0, 1, [0.5, 0.5])]
    return spark.createDataFrame(rows, "sample_id bigint, layer int, head int, pos int, row array<double>")


def test_attention_score(spark):
    got = by_sample(un.attention_score(attention_table(spark), spans(spark, [(0, 0, 2), (1, 0, 2)]), 0), "attn_eig")
    assert got[0] == pytest.approx(-2.9957322736, abs=1e-9)
    assert got[1] == -INF
    empty = by_sample(un.attention_score(attention_table(spark), spans(spark, [(0, 5, 6)]), 0), "attn_eig")
    assert math.isnan(empty[0])


def test_attention_diagonal(spark):
    rows = un.attention_diagonal(attention_table(spark), layer=0, head=0, start=0, end=1, sample_id=1).collect()
    assert [(r["pos"], round(r["log_diagonal"], 6)) for r in rows] == [(0, round(math.log(1e-12), 6))]


def test_combined_metrics(spark):
    logits = logits_table(spark, [[[2, 1, 0], [0, 0, 0]]] * 3)
    hidden = hidden_table(spark, [[[1, 2, 3], [2, 0, 1]]] * 2)
    where = spans(spark, [(0, 0, 2), (1, 2, 2), (2, 0, 2)])
    rows = un.calculate_metrics(where, logits, hidden, attention_table(spark), layer=0).collect()
    got = {r["sample_id"]: r for r in rows}
    assert got[0]["svd_score"] == pytest.approx(0.5499725334)
    assert math.isnan(got[1]["svd_score"]) and math.isnan(got[1]["logit_entropy"])
    assert (got[2]["svd_score"], got[2]["attn_eig"]) == (0.0, 0.0)
    candidates = spark.createDataFrame([(i,) for i in range(4)], "sample_id bigint")
    scores = un.calculate_metrics(where, logits, hidden, None, layer=0).withColumn("full_prompt", F.lit("p"))
    filled = {r["sample_id"]: r for r in un.attach_scores(candidates, scores, ["sample_id"]).collect()}
    for failed in (1, 3):
        r = filled[failed]
        assert (r["svd_score"], r["attn_eig"], r["logit_entropy"], r["full_prompt"]) == (INF, 0.0, 0.0, "")
    assert filled[0]["full_prompt"] == "p"


def test_missing_logits_fail(spark):
    logits = logits_table(spark, [[[2, 1]]])
    with pytest.raises(Exception, match="no logits for sample 7"):
        un.calculate_metrics(spans(spark, [(7, 0, 1)]), logits, None, None, layer=0).collect()
    tolerant = un.calculate_metrics(spans(spark, [(7, 0, 1), (0, 0, 1)]), logits, None, None, layer=0, strict=False)
    assert [r["sample_id"] for r in tolerant.collect()] == [0]


def test_span_and_layer(spark):
    table = hidden_table(spark, [[[1], [2], [3]]], layer=3)
    assert un.span_tokens(table, spans(spark, [(0, 1, 2)])).count() == 1
    assert un.middle_layer(table, 7).count() == 3
    assert un.middle_layer(table, 8).count() == 0


CASES = {
    "mode differs from lowest": ([-3.0, -1.0, -0.9, -1.1, 2.0], 3),
    "all equal": ([1.0, 1.0, 1.0], 0),
    "one valid": ([INF, 4.0, INF], 1),
    "none valid": ([INF, NAN, None], 0),
    "some invalid": ([NAN, -1.0, INF, -0.9, -1.1, 2.0, None, -3.0], 4),
    "minus infinity": ([1.0, -INF, 2.0], 1),
    "near equal": ([1.0, 1.0 + 1e-9, 1.0 - 1e-9], 2),
    "single": ([7.0], 0),
}


def candidate_table(spark, cases):
    rows = [(k, i, s, f"t{i}") for k, scores in cases.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "input_key string, sample_idx int, score double, text string")


@pytest.mark.parametrize("group_limit", [1000, 2])
def test_best_candidates(spark, group_limit):
    """With a low limit most inputs take the path for very many candidates."""
    table = candidate_table(spark, {k: v[0] for k, v in CASES.items()}).repartition(3)
    rows = sel.best_candidates(table, "input_key", payload=["text"], group_limit=group_limit).collect()
    got = {r["input_key"]: r["sample_idx"] for r in rows}
    # symmetric scores: which of two equal peaks wins hangs on the last bit
    expected = {k: v[1] for k, v in CASES.items() if k != "near equal"}
    assert {k: got[k] for k in expected} == expected
    assert all(r["text"] == f"t{r['sample_idx']}" for r in rows)


def test_best_candidates_equal_definition(spark):
    rng = np.random.default_rng(3)
    cases = {str(i): [float(x) for x in rng.normal(size=rng.integers(3, 9)).round(6)] for i in range(200)}
    expected = {k: brute_pick(v) for k, v in cases.items()}
    for limit in (1000, 4):
        rows = sel.best_candidates(candidate_table(spark, cases), "input_key", group_limit=limit).collect()
        assert {r["input_key"]: r["sample_idx"] for r in rows} == expected
    lowest = sel.lowest_candidates(candidate_table(spark, cases), "input_key").collect()
    assert {r["input_key"]: r["sample_idx"] for r in lowest} != expected


def test_density_mode_forms_agree(spark):
    scores = [v[0] for v in CASES.values()]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s array<double>")
    rows = df.select("i", sc.density_mode(F.col("s")).alias("a"), sc.density_mode_arrow(F.col("s")).alias("b")).collect()
    for r in rows:
        assert (r["a"] is None) == (r["b"] is None)
        if r["a"] is not None:
            assert r["a"] == pytest.approx(r["b"], abs=1e-9)
    assert rows[0]["b"] == pytest.approx(-1.1680623253, abs=1e-9)


def test_moments(spark):
    row = sel.score_moments(candidate_table(spark, {"a": CASES["mode differs from lowest"][0]}), "input_key").first()
    assert (row["sd"], row["bandwidth"]) == pytest.approx((1.6012495121, 1.2292854942), abs=1e-9)


def test_ranking(spark):
    table = candidate_table(spark, {"a": [2.0, NAN, 1.0, INF, 1.0, None]})
    rows = sel.rank_candidates(table, "input_key").collect()
    assert [r["sample_idx"] for r in sorted(rows, key=lambda r: r["rank"])] == [2, 4, 0, 1, 3, 5]


def test_input_results(spark):
    table = candidate_table(spark, {"a": [2.0, 1.0, 3.0]})
    grouped = gen.regroup(table, "input_key", ["score", "text"])
    (row,) = sel.input_results(grouped, "input_key").collect()
    assert [s["text"] for s in row["samples"]] == ["t1", "t0", "t2"]
    empty = spark.createDataFrame([("x", [])], "input_key string, samples array<struct<sample_idx:int,text:string,score:double>>")
    assert sel.input_results(empty, "input_key").first()["best_sample"] == ""


def test_few_jobs_to_plan_the_metrics(spark):
    """The spans are stored and looked at once; the scores themselves need no job to be planned."""
    logits = spark.range(60).select((F.col("id") / 6).cast("int").alias("sample_id"), (F.col("id") % 6).alias("pos"), F.array(F.lit(1.0), F.lit(2.0)).alias("logits"))
    hidden = logits.select("sample_id", "pos", F.col("logits").alias("vec"), F.lit(0).alias("layer"))
    spans = un.stored_spans(logits.select("sample_id", F.lit(1).alias("start"), F.lit(4).alias("end")).distinct())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "metrics")
    try:
        out = un.calculate_metrics(spans, logits, hidden, None, layer=0)
        assert len(tracker.getJobIdsForGroup("planning")) == 0
        assert out.count() == 10
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_products_are_held_one_at_a_time(monkeypatch):
    """Many short samples of one batch: no more matrices are held than the limit allows."""
    import pyarrow as pa

    n, d = 400, 32
    monkeypatch.setattr(un, "_HELD_BYTES", 4 * 8 * d * d)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(n, d))
    ids = np.arange(n) % 100
    batch = pa.record_batch({"sample_id": pa.array(ids), "vec": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    out = list(un._partial_products(iter([batch])))
    assert len(out) == 100 and all(b.num_rows == d for b in out)
    z = vectors - vectors.mean(1, keepdims=True)
    for b in out:
        own = z[ids == b.column("sample_id")[0].as_py()]
        assert np.allclose(np.array(b.column("products").to_pylist()), own.T @ own) and b.column("tokens")[0].as_py() == 4


def test_mean_entropy_forms_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(i % 4, 12)).tolist()) for i in range(12)] + [(20, None), (21, [[1.0, 2.0], []]), (22, [[0.0, -2000.0], [1.0, 1.0]]), (23, [[1.0], [2.0, 3.0]])]
    df = spark.createDataFrame(rows, "id int, tokens array<array<double>>").repartition(3)
    for top_k in (None, 1, 5, 50):
        both = df.select("id", sc.mean_token_entropy(F.col("tokens"), top_k).alias("a"), sc.mean_token_entropy_arrow(F.col("tokens"), top_k).alias("b")).collect()
        for r in both:
            assert (r["a"] is None) == (r["b"] is None), r
            if r["a"] is not None:
                assert r["a"] == pytest.approx(r["b"], rel=1e-9, abs=1e-12, nan_ok=True), r
