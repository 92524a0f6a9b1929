"""Skewed groups, sampling, label words, resuming, files and streams."""

import hashlib
import math
import os
import statistics
import uuid

import numpy as np
import pytest
from generators import counting_factory, picky_scorer, short_factory
from pyspark.sql import functions as F

from augspark.functions import templates
from augspark.functions.scoring import density_mode
from augspark.operators import chats, fewshot as fs, generate as gen, incremental as inc, lexicon as lx, skew
from augspark.operators import uncertainty as un
from augspark.plans import augment, classify, datasets, fixtures as fx, label_words
from augspark.sources import catalog, labeled, lexicons, sinks
from augspark.streaming.augment import augment_files


def hot_table(spark, rows=3000):
    """A third of the rows have one key; some keys are null."""
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40)
    value = F.xxhash64("id") % 1000
    return spark.range(0, rows, 1, 4).select(key.alias("k"), value.alias("v"), F.col("id").alias("unique_id"))


# -- skew ---------------------------------------------------------------------------------------


def test_split_by_group_size(spark):
    df = hot_table(spark)
    small, large = skew.split_by_group_size(df, ["k"], 100)
    assert {r["k"] for r in large.select("k").distinct().collect()} == {-1}
    assert small.count() + large.count() == 3000
    assert skew.split_by_group_size(df, ["k"], 10_000)[1] is None


def test_heavy_hashes(spark):
    df = hot_table(spark)
    (heavy,) = skew.heavy_hashes(df, ["k"], 100)
    assert {r["k"] for r in df.where(F.xxhash64("k") == heavy).select("k").distinct().collect()} == {-1}
    assert skew.heavy_hashes(df, ["k"], 10_000) == []
    assert skew.heavy_hashes(df.where("false"), ["k"], 1) == []


@pytest.mark.parametrize("limit", [10_000, 100, 30])
def test_row_numbers(spark, limit):
    """The rank is the same whether groups are ranked by a window or by the global sort."""
    df = hot_table(spark)
    rows = skew.row_numbers(df, ["k"], [F.col("v").desc(), F.col("unique_id")], limit=limit).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["k"], []).append(r)
    assert len(rows) == 3000
    for group in groups.values():
        expected = sorted(group, key=lambda r: (-r["v"], r["unique_id"]))
        assert [r["rank"] for r in expected] == list(range(1, len(group) + 1))


def test_global_position(spark):
    rows = skew.global_position(hot_table(spark), [F.col("v"), F.col("unique_id")]).collect()
    expected = sorted(rows, key=lambda r: (r["v"], r["unique_id"]))
    assert [r["position"] for r in expected] == list(range(3000))
    assert skew.global_position(hot_table(spark).where("false"), [F.col("v")]).count() == 0


def test_hashed_position(spark):
    rows = skew.hashed_position(hot_table(spark), "unique_id", 7).collect()
    digest = lambda r: hashlib.md5(f"7:{r['unique_id']}".encode()).hexdigest()
    assert [r["position"] for r in sorted(rows, key=digest)] == list(range(3000))


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_first_n_per_group(spark, threshold):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        df = hot_table(spark)
        rows = skew.first_n_per_group(df, ["k"], [F.col("v"), F.col("unique_id")], 5).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    table = df.collect()
    for k in {r["k"] for r in table}:
        expected = sorted((r["v"], r["unique_id"]) for r in table if r["k"] == k)[:5]
        assert sorted((r["v"], r["unique_id"]) for r in rows if r["k"] == k) == expected


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    made = spark.range(10).select(F.col("id"), F.lit("text").alias("text"))
    step = augment.augment_best_of_n(made, fx.stub_factory, lambda t, s: F.length(s).cast("double"))
    assert "Exchange" not in plan(step), "the array layout is map-only"
    assert plan(step).count("ArrowEvalPython") == 2, "one call of the generator, one of the density mode"
    step = augment.augment_with_scorer(made, fx.stub_factory, fx.length_scorer)
    assert "Exchange" not in plan(step) and plan(step).count("ArrowEvalPython") == 3
    shots = plan(fs.sample_shots(hot_table(spark).withColumnRenamed("k", "label"), "unique_id"))
    assert shots.count("WindowGroupLimit") >= 1, "each task keeps its first rows before the shuffle"
    lexicon = fx.fx_lexicon(spark)
    scores = spark.range(5).select(F.col("id").alias("example"), (F.col("id") % 3).alias("word"), F.lit(0.5).alias("logit"))
    assert "BroadcastHashJoin" in plan(lx.word_probabilities(scores, lexicon))


def test_layers_are_pruned(spark, tmp_path):
    path = str(tmp_path / "hidden")
    rows = spark.range(20).select((F.col("id") % 4).alias("layer"), F.col("id").alias("sample_id"))
    rows.write.partitionBy("layer").parquet(path)
    shown = plan(un.middle_layer(spark.read.parquet(path), 4))
    assert "PartitionFilters: [isnotnull(layer" in shown and "= 2)" in shown


def test_scan_is_pruned(spark):
    df = fx.table(spark, "/root/testdata/sf0.001", "documents")
    shown = plan(fs.shuffled_batches(df.select("doc_id"), "doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in shown


# -- generation ---------------------------------------------------------------------------------


def test_batches_and_options(spark):
    df = spark.range(0, 3, 1, 1).select(F.lit("p").alias("p"))
    made = df.select(gen.generated_samples(F.col("p"), counting_factory, n_samples=2, batch_size=4, top_p=0.5).alias("s"))
    got = [s["text"] for r in made.collect() for s in r["s"]]
    assert got == ["4/0/0.7/0.5/128", "4/1/0.7/0.5/128"] * 2 + ["2/0/0.7/0.5/128", "2/1/0.7/0.5/128"]


def test_failures(spark):
    texts = ["1234567", "a", None, "bb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for mode, bad in (("empty", ""), ("skip", None)):
        rows = gen.generate_text(df, F.col("t"), fx.failing_factory, on_error=mode).collect()
        assert [r["generated"] for r in rows] == [bad, fx.stub_text("a", 0), None, fx.stub_text("bb", 0)]
        assert [r["error"] for r in rows] == ["model failed", None, "no prompt", None]
    with pytest.raises(Exception, match="model failed"):
        gen.generate_text(df, F.col("t"), fx.failing_factory).collect()
    with pytest.raises(ValueError):
        gen.generated_samples(F.col("t"), fx.stub_factory, on_error="ignore")


def test_wrong_number_of_texts(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="got 0 results for 1 prompts"):
        gen.generate_text(df, F.col("t"), short_factory).collect()


def test_regroup_and_spread(spark):
    df = gen.fan_out(spark.range(50).withColumnRenamed("id", "key"), 3).withColumn("x", F.col("key") * 10 + F.col("sample_idx"))
    rows = gen.regroup(df.where("x != 11"), "key", ["x"], 3).collect()
    for r in rows:
        expected = [r["key"] * 10 + i for i in range(3) if r["key"] * 10 + i != 11]
        assert [s["x"] for s in r["samples"]] == expected
    for wrong in (df.union(df.limit(1)), df.withColumn("sample_idx", F.col("sample_idx") + 1)):
        with pytest.raises(Exception, match="sample number for"):
            gen.regroup(wrong, "key", ["x"], 3).collect()
    spread = gen.generate_text(spark.range(100).coalesce(1), F.col("id").cast("string"), fx.stub_factory, spread=4)
    assert spread.rdd.getNumPartitions() == 4
    texts = spark.range(100).coalesce(1).select("id", F.col("id").cast("string").alias("text"))
    assert augment.with_samples(texts, fx.stub_factory, spread=5).rdd.getNumPartitions() == 5


def test_augment_drops_nulls(spark):
    df = spark.createDataFrame([(1, "one. two"), (2, None)], "id int, text string")
    rows = augment.augment_best_of_n(df, fx.stub_factory, lambda t, s: F.length(s).cast("double"), prompt=fx.whole_prompt)
    assert [tuple(r) for r in rows.collect()] == [(1, f"one. two aug {fx.digest('one. two')}: one.", 0)]


def test_scores_missing_for_some_samples(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    scores = spark.createDataFrame([(1, 2, 5.0)], "id int, sample_idx int, svd_score double")
    rows = augment.augment_with_scores(df, fx.stub_factory, scores, "id", n_samples=3, prompt=fx.whole_prompt).collect()
    assert {r["id"]: (r["sample_idx"], r["text"]) for r in rows} == {1: (2, "a " + fx.stub_text("a", 2)), 2: (0, "b " + fx.stub_text("b", 0))}


def test_scorer(spark):
    df = spark.createDataFrame([(["a", "fault", None, ""],), (None,), ([],)], "p array<string>").coalesce(1)
    rows = df.select(gen.sample_scores(F.lit("x"), F.col("p"), picky_scorer, batch_size=3).alias("s")).collect()
    assert [r["s"] for r in rows] == [[2.0, None, None, 1.0], None, []]
    df = spark.createDataFrame([(1, "a fault"), (2, "fine")], "id int, text string")
    out = augment.augment_with_scorer(df, fx.stub_factory, picky_scorer, lang="zh").collect()
    assert [(r["id"], r["sample_idx"]) for r in out] == [(1, 0), (2, 0)], "without scores the first sample is kept"


def test_columns_of_python_functions(spark):
    """Texts and scores may come from Python functions, which Spark does not evaluate inside lambdas."""
    same_text = F.arrow_udf(lambda a: a, "string").asNondeterministic()
    same_array = F.arrow_udf(lambda a: a, "array<double>").asNondeterministic()
    df = spark.createDataFrame([(1, "one. two", [1.0, 2.0, 0.5])], "id int, raw string, raw_logits array<double>")
    df = df.select("id", same_text("raw").alias("text"), same_array("raw_logits").alias("logits"))
    first = augment.augment_best_of_n(df, fx.stub_factory, score_by_length, prompt=fx.whole_prompt)
    second = augment.augment_with_scorer(df, fx.stub_factory, fx.length_scorer, prompt=fx.whole_prompt)
    assert first.first()["text"] == second.first()["text"] == f"one. two aug {fx.digest('one. two')}: one."
    lexicon = lx.LexiconArrays((0, 1), (0, 1), (0.0, 0.0))
    scored = lx.class_score_arrays(df, lexicon).select(lx.predicted_class(F.col("class_scores")))
    assert scored.first()[0] == 1


def test_scoring_prompts(spark):
    df = spark.createDataFrame([(1, "hello")], "id int, text string")
    made = augment.with_samples(df, fx.stub_factory, n_samples=2, prompt=fx.whole_prompt)
    rows = augment.scoring_prompts(made, "id").orderBy("sample_idx").collect()
    assert rows[1]["full_prompt"].endswith("user\nhelloassistant\n" + fx.stub_text("hello", 1))


@pytest.mark.parametrize("limit", [10_000, 100])
def test_long_conversation_is_cut(spark, monkeypatch, limit):
    # above the group limit the turns are ranked by the global sort
    monkeypatch.setattr(skew, "GROUP_LIMIT", limit)
    turns = spark.range(1000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chats.render_conversations(turns.repartition(5), part_turns=300).orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2, 3]
    assert "".join(r["rendered"] for r in parts) == "".join(f"u\n{i}" for i in range(1000))


def test_reply_goes_to_the_end_once(spark):
    turns = spark.range(600).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    body = "".join(f"u\n{i}" for i in range(600))
    whole = chats.with_reply(turns.repartition(5), F.lit("yes")).collect()
    assert [r["rendered"] for r in whole] == [body + "assistant\nyes" + "assistant\n"]
    parts = chats.with_reply(turns.repartition(5), F.lit("yes"), part_turns=256).orderBy("part").collect()
    assert len(parts) == 3 and "".join(r["rendered"] for r in parts) == whole[0]["rendered"]
    assert [r["rendered"] for r in chats.render_conversations(turns).collect()] == [body]


def test_models_load_once_per_worker(spark, tmp_path):
    def factory():
        (tmp_path / uuid.uuid4().hex).touch()
        return lambda prompts, sample_idx, **options: list(prompts)

    texts = spark.range(10).select(F.col("id").cast("string").alias("text")).repartition(20)
    for _ in range(3):
        assert gen.generate_text(texts, F.col("text"), factory).where("error is not null").count() == 0
    assert 1 <= len(list(tmp_path.iterdir())) <= 16, "three runs of 20 tasks on 8 cores; Spark may start a second worker on a core"


def test_nulls_in_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "id int, text string, note string")
    step = lambda **more: augment.augment_best_of_n(df, fx.stub_factory, score_by_length, prompt=fx.whole_prompt)
    assert [(r["id"], r["note"]) for r in step().collect()] == [(1, None)]


def test_failures_of_the_whole_step(spark, tmp_path):
    df = spark.createDataFrame([(1, "fine"), (2, "sevench"), (3, "also fine")], "id int, text string")
    chosen, rejects = augment.augment_with_rejects(
        df, str(tmp_path / "store"), "id", fx.failing_factory, score_by_length, prompt=fx.whole_prompt, n_samples=2
    )
    assert sorted(r["id"] for r in chosen.collect()) == [1, 3]
    assert sorted(tuple(r) for r in rejects.collect()) == [(2, 0, "model failed", True), (2, 1, "model failed", True)]


@pytest.mark.parametrize("name", ["tweets", "ToxiGen", "LHd", "weibo"])
def test_class_of_the_first_label_word(spark, tmp_path, name):
    known = catalog.find_dataset(name)
    folder = tmp_path / known.scripts
    folder.mkdir(parents=True)
    for kind in ("manual", "adj", "kpt++"):
        (folder / f"{kind}_verbalizer.txt").write_text("bully,insult\nkind,calm\n", encoding="utf-8")
        words = {r["word"]: known.classes[r["class_id"]] for r in catalog.dataset_lexicon(spark, str(tmp_path), name, kind).collect()}
        assert words["bully"] in ("cyberbullying", "暴力") and words["kind"] in ("not_cyberbullying", "非暴力")
        with pytest.raises(ValueError, match="no label-word set 3"):
            lexicons.read_lexicon(spark, str(folder / f"{kind}_verbalizer.txt"), choice=3)


def test_stray_braces_and_odd_files(spark, tmp_path):
    for bad in ("a } b", "a { b", '{"mask"} } x'):
        with pytest.raises(ValueError):
            templates.parse_template(bad)
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("line", encoding="utf-8")
    with pytest.raises(ValueError, match="several files"):
        templates.read_whole(spark, str(tmp_path / "*.txt"))
    with pytest.raises(ValueError, match="more than the limit"):
        templates.read_whole(spark, str(tmp_path / "a.txt"), limit=2)


def test_csv_output_keeps_texts(spark, tmp_path):
    rows = [(1, "  hi there  "), (2, ""), (3, None), (4, 'say "x", y'), (5, "two\nlines\n"), (6, " "), (7, "\\ back")]
    path = str(tmp_path / "out")
    sinks.append_rows(spark.createDataFrame(rows, "id int, text string").coalesce(2), path, "csv")
    back = inc.read_written(spark, path, "csv")
    assert sorted((int(r["id"]), r["text"]) for r in back.collect()) == rows
    assert inc.written_rows(spark, path, "csv") == len(rows)


def test_prior_is_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = spark.range(200).select((F.col("id") % 20).alias("example"), (F.col("id") / 20).cast("int").alias("word"), F.lit(0.5).alias("logit"))
        lexicon = spark.range(10).select(F.col("id").cast("int").alias("word"), (F.col("id") % 2).cast("int").alias("class_id"))
        p = lx.word_probabilities(scores, lexicon)
        found = plan(lx.calibrated_probabilities(p, lx.calibration_prior(scores, lexicon)))
        assert "SortMergeJoin" not in found and "hashpartitioning(word" not in found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- label words --------------------------------------------------------------------------------


def test_label_word_choice(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i % 60}" for i in range(240)]
    vectors = rng.normal(size=(240, 6))
    tokens = spark.createDataFrame([(w, i, [float(x) for x in v]) for i, (w, v) in enumerate(zip(words, vectors))], "word string, pos int, vec array<double>")
    anchors = spark.createDataFrame([("neg", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("pos", [0.0, 1.0, 0.0, 1.0, 0.0, 0.0])], "label string, vec array<double>")
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    expected = {}
    for w in words:
        mean = vectors[[x == w for x in words]].mean(axis=0)
        expected[w] = statistics.stdev([cos(mean, np.array(a)) for a in ([1.0, 0, 0, 0, 1, 0], [0.0, 1, 0, 1, 0, 0])])
    top = label_words.discriminative_words(tokens.repartition(4), anchors, ["neg", "pos"])
    best = sorted(expected, key=lambda w: -expected[w])[:30]
    assert [r["word"] for r in top.collect()] == best
    assert lx.word_line(top).first()[0] == ",".join(best)
    one = spark.range(1).select(lx.spread([F.lit(0.8), F.lit(0.3)]), lx.spread([F.lit(1.0), F.lit(2.0), F.lit(4.0)])).first()
    assert tuple(one) == pytest.approx((0.3535533906, statistics.stdev([1, 2, 4])))


def test_equal_scores_keep_word_order(spark):
    scored = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 2, 0.9)], "word string, pos int, score double")
    assert lx.word_line(lx.top_words(scored, 2)).first()[0] == "c,a"


def word_scores(spark):
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(30, 12)) * 2
    rows = [(e, [float(x) for x in row]) for e, row in enumerate(logits)]
    arrays = spark.createDataFrame(rows, "example int, logits array<double>")
    return logits, arrays, arrays.select("example", F.posexplode("logits").alias("word", "logit"))


LEXICON = [(0, 0, 1.0), (3, 0, 0.5), (5, 1, 0.0), (7, 1, 2.0), (8, 1, 1.0), (11, 2, 0.0)]


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("calibrated", [False, True])
def test_class_scores(spark, weighted, calibrated):
    logits, arrays, rows = word_scores(spark)
    lexicon = spark.createDataFrame(LEXICON, "word int, class_id int, weight double")
    ids = [w for w, _, _ in LEXICON]
    p = np.exp(logits[:, ids]) / np.exp(logits[:, ids]).sum(axis=1, keepdims=True)
    if calibrated:
        prior = np.exp(logits[:10, ids].mean(axis=0))
        p = p / (prior / prior.sum())
        p = p / p.sum(axis=1, keepdims=True)
    log_p = np.log(p + 1e-15)
    expected = []
    for c in range(3):
        at = [i for i, (_, k, _) in enumerate(LEXICON) if k == c]
        w = np.exp([1.5 * LEXICON[i][2] for i in at]) if weighted else np.ones(len(at))
        expected.append(log_p[:, at] @ (w / w.sum()))
    expected = np.array(expected).T

    small = lx.collect_lexicon(lexicon)
    prior = lx.array_prior(arrays.where("example < 10"), small) if calibrated else None
    scored = lx.class_score_arrays(arrays, small, prior, 1.5 if weighted else None)
    got = {r["example"]: r for r in scored.withColumn("pred", lx.predicted_class(F.col("class_scores"))).collect()}
    for e in range(30):
        assert got[e]["class_scores"] == pytest.approx(list(expected[e]), abs=1e-9)
        assert got[e]["pred"] == expected[e].argmax()
    support = rows.where("example < 10") if calibrated else None
    preds = label_words.classify_by_words(rows, lexicon, support, weighted, 1.5).collect()
    assert {r["example"]: r["pred"] for r in preds} == {e: int(expected[e].argmax()) for e in range(30)}


def test_refine(spark):
    prior = spark.createDataFrame([(w, p) for w, p in enumerate([0.3, 0.1, 0.2, 0.05, 0.35])], "word int, prior double")
    lexicon = spark.createDataFrame([(w, 0) for w in range(5)], "word int, class_id int")
    assert {r["word"] for r in lx.refine_lexicon(lexicon, prior).collect()} == {0, 2, 4}
    assert {r["word"] for r in lx.refine_lexicon(lexicon, prior, 0.0).collect()} == set(range(5))


def test_argmax_takes_the_first_class(spark):
    scores = spark.createDataFrame([(1, 2, -1.0), (1, 1, -1.0), (1, 0, -3.0)], "example int, class_id int, class_score double")
    assert fs.predict_class(scores).first()["pred"] == 1


# -- sampling and evaluation --------------------------------------------------------------------


def test_shots(spark):
    df = hot_table(spark).withColumnRenamed("k", "label")
    once = {tuple(r) for r in fs.sample_shots(df, "unique_id", shots=7, seed=1).collect()}
    again = {tuple(r) for r in fs.sample_shots(df.repartition(3), "unique_id", shots=7, seed=1).collect()}
    other = {tuple(r) for r in fs.sample_shots(df, "unique_id", shots=7, seed=2).collect()}
    assert once == again != other
    assert len({r[0] for r in once}) == len(once), "no row is in both splits"
    counts = {}
    for _, label, split in once:
        counts[label, split] = counts.get((label, split), 0) + 1
    assert max(counts.values()) == 7
    assert fs.sample_total(df, "unique_id", 200).distinct().count() == 200


def test_batches(spark):
    rows = fs.shuffled_batches(spark.range(100), "id", 30, seed=3).collect()
    sizes = [sum(r["batch_id"] == b for r in rows) for b in range(4)]
    assert sizes == [30, 30, 30, 10]


def predictions(spark, label, pred):
    return spark.createDataFrame(list(zip(label, pred)), "label int, pred int")


def test_evaluate(spark):
    row = fs.evaluate(predictions(spark, [1, 0, 1, 1, 0], [1, 1, 0, 1, 0])).first()
    assert (row["accuracy"], row["rmse"], row["mae"]) == pytest.approx((0.6, 0.6324555320, 0.4))
    assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    none = fs.evaluate(predictions(spark, [1, 0], [0, 0])).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0, 0, 0)
    zero = fs.evaluate(predictions(spark, [0, 0, 1], [0, 1, 1]), positive_label=0).first()
    assert (zero["precision"], zero["recall"]) == (1, 0.5)


def test_best_epoch(spark):
    epochs = spark.createDataFrame([(0, 0.8, 1.0), (1, 0.9, 2.0), (2, 0.9, 3.0)], "epoch int, val_acc double, rmse double")
    assert tuple(fs.best_epoch(epochs).first()) == (2, 0.9, 3.0)


def test_classifier(spark):
    rows = [("good fine nice", 1), ("bad awful mean", 0), ("nice good", 1), ("awful bad", 0)] * 5
    df = spark.createDataFrame(rows, "text string, label int")
    assert fs.evaluate(fs.classify(fs.fit_classifier(df), df)).first()["accuracy"] == 1.0


# -- identity and resuming ----------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10_000, 5])
def test_copies_are_numbered(spark, limit):
    df = hot_table(spark, 300).withColumn("text", F.when(F.col("k") == -1, "copy").otherwise(F.col("unique_id").cast("string")))
    rows = inc.with_content_key(df, ["text"], [F.col("unique_id")], limit).collect()
    assert len({(r["content_key"], r["occurrence"]) for r in rows}) == 300
    copies = sorted((r["unique_id"], r["occurrence"]) for r in rows if r["text"] == "copy")
    assert [o for _, o in copies] == list(range(1, 101))


def test_null_and_empty_differ(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a")], "x string, y string")
    assert df.select(inc.content_hash(F.col("x"), F.col("y"))).distinct().count() == 2


def test_resume_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    df = hot_table(spark, 200)
    assert inc.written_rows(spark, path) == 0
    df.where("unique_id < 70").write.parquet(path)
    for _ in range(2):
        rest = inc.unprocessed(df, spark.read.parquet(path), ["unique_id"])
        sinks.append_rows(rest, path)
        assert inc.written_rows(spark, path) == 200
    lines = df.select(F.concat_ws("\n", F.lit("two"), F.lit("lines, and a comma")).alias("text"), "unique_id")
    sinks.append_rows(lines, path + "-csv", "csv")
    assert inc.written_rows(spark, path + "-csv", "csv") == 200
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert inc.unprocessed(nulls, nulls.where("k is null"), ["k"]).collect()[0]["k"] == 1


def score_by_length(text, sample):
    return F.length(sample).cast("double")


def test_pending_rows(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.range(30).select("id", F.concat(F.lit("text "), "id").alias("text"))
    step = lambda d: augment.augment_best_of_n(d, fx.stub_factory, score_by_length, prompt=fx.whole_prompt)
    for part in (df.where("id < 10"), df, df):
        augment.augment_pending(part, target, ["id"], step)
    got = [tuple(r) for r in spark.read.parquet(target).select("id", "text").collect()]
    assert sorted(got) == [(i, f"text {i} " + fx.stub_text(f"text {i}", 0)) for i in range(30)]


def test_finished_batches_survive_a_failure(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.range(60).select("id", F.concat(F.lit("text "), "id").alias("text"))
    good = lambda d: augment.augment_best_of_n(d, fx.stub_factory, score_by_length, prompt=fx.whole_prompt)
    calls = []

    def third_batch_fails(part):
        calls.append(1)
        return good(part) if len(calls) < 3 else good(part).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        augment.augment_pending(df, target, ["id"], third_batch_fails, batches=5)
    kept = inc.written_rows(spark, target)
    assert 0 < kept < 60
    augment.augment_pending(df, target, ["id"], good, batches=5)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(60))


def test_dataset_is_augmented_in_place(spark, tmp_path):
    folder = tmp_path / "Cyberbullying" / "ToxiGen"
    os.makedirs(folder)
    (folder / "test_no_aug.csv").write_text('0,"one, two"\n1,copy\n1,copy\n0,NA\n')
    step = lambda d: augment.augment_best_of_n(d, fx.stub_factory, score_by_length, prompt=fx.whole_prompt).drop("sample_idx")
    for _ in range(2):
        datasets.augment_dataset(spark, str(tmp_path), "ToxiGen", step)
        rows = catalog.read_split(spark, str(tmp_path), "ToxiGen", "test").collect()
        assert sorted((r["label"], r["text"]) for r in rows) == [
            (0, "one, two " + fx.stub_text("one, two", 0)), *[(1, "copy " + fx.stub_text("copy", 0))] * 2,
        ]


def test_rejects_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("1234567",), ("a",)], "t string")
    made = gen.generate_text(df, F.col("t"), fx.failing_factory, on_error="skip")
    good, bad = gen.store_with_rejects(made, str(tmp_path / "made"))
    assert [r["generated"] for r in good.collect()] == [fx.stub_text("a", 0)]
    assert [(r["t"], r["error"]) for r in bad.collect()] == [("1234567", "model failed")]


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.range(0, 90, 1, 3).select("id", F.concat(F.lit("text "), "id").alias("text"))
    step = lambda d: augment.augment_best_of_n(d, fx.stub_factory, score_by_length, prompt=fx.whole_prompt)
    for part in ("id < 40", "id >= 40"):
        df.where(part).write.mode("append").parquet(source)
        augment_files(spark, source, df.schema, target, state, step, files_per_batch=2).awaitTermination()
    batch = {tuple(r) for r in step(df).collect()}
    streamed = [tuple(r) for r in spark.read.parquet(target).select(*step(df).columns).collect()]
    assert len(streamed) == 90 and set(streamed) == batch


# -- files --------------------------------------------------------------------------------------

ODD_TEXTS = ['a "quoted" text', "two\nlines, and a comma", "", "NA", " edge ", 'ends with "', "\\back\\slash\\", "ünï 某人"]


def test_csv_like_python(spark, tmp_path):
    import csv

    path = tmp_path / "d.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([(i % 2, t) for i, t in enumerate(ODD_TEXTS)])
    got = [(r["label"], r["text"]) for r in labeled.read_labeled(spark, str(path)).collect()]
    assert got == [(i % 2, t) for i, t in enumerate(ODD_TEXTS)]


def test_csv_round_trip_and_missing(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "label int, text string")
    sinks.write_labeled_csv(df, path, header=True)
    got = {tuple(r) for r in labeled.read_labeled(spark, path, header=True).collect()}
    assert got == {(t, i) for i, t in enumerate(ODD_TEXTS)}
    missing = labeled.read_augmentation_input(spark, path).where("tweet_text is null").count()
    assert missing == 2


def test_byte_order_mark_and_mask(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("﻿1,hi USERNAME\n0,你好\n".encode())
    for multiline in (True, False):
        got = labeled.read_labeled(spark, str(path), mask_users=True, multiline=multiline).collect()
        assert [tuple(r) for r in got] == [("hi 某人", 1), ("你好", 0)]


def test_bad_labels(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("x,one\n1,two\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labeled.read_labeled(spark, str(path)).collect()
    good, bad = labeled.rejects(labeled.read_labeled(spark, str(path), strict=False))
    assert (good.count(), bad.first()["text"]) == (1, "one")
    path.write_text("1,two,three\n0,four\n1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        labeled.read_labeled(spark, str(path)).collect()
    for multiline in (True, False):
        rows = labeled.read_labeled(spark, str(path), strict=False, multiline=multiline).collect()
        assert [tuple(r) for r in rows] == [("1,two,three", None), ("four", 0), ("1", None)]


def test_catalog(spark, tmp_path):
    folder = tmp_path / "Cyberbullying" / "tweets"
    os.makedirs(folder)
    for split in ("train", "test", "validation"):
        (folder / f"{split}.csv").write_text('text,label\n"a, b",cyberbullying\nc,not_cyberbullying\n')
    rows = catalog.read_dataset(spark, str(tmp_path), "tweets").collect()
    assert len(rows) == 6 and {(r["text"], r["label"]) for r in rows} == {("a, b", 0), ("c", 1)}
    with pytest.raises(ValueError, match="unknown dataset"):
        catalog.read_dataset(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="no split"):
        catalog.read_split(spark, str(tmp_path), "LHd", "validation")


def test_dataset_scripts(spark, tmp_path):
    """ToxiGen shares the label words of tweets, whose lines are in the opposite class order."""
    folder = tmp_path / "Cyberbullying" / "tweets"
    os.makedirs(folder)
    (folder / "adj_verbalizer.txt").write_text("bad,awful\ngood\n")
    (folder / "manual_template.txt").write_text('zero\n {"placeholder": "text_a"} is {"mask"}\n')
    by_class = lambda name: {
        (r["word"], r["class_id"]) for r in catalog.dataset_lexicon(spark, str(tmp_path), name, "adj").collect()
    }
    assert by_class("tweets") == {("bad", 0), ("awful", 0), ("good", 1)}
    assert by_class("ToxiGen") == {("bad", 1), ("awful", 1), ("good", 0)}
    assert catalog.dataset_template(spark, str(tmp_path), "LHd", "manual", 1) == ' {"placeholder": "text_a"} is {"mask"}'


def test_report(spark):
    row = classify.report(predictions(spark, [1, 0], [1, 1]), {"dataset": "tweets", "seed": 1}).first()
    assert (row["dataset"], row["accuracy"], row["precision"], row["recall"]) == ("tweets", 0.5, 0.5, 1.0)


def test_lexicon_file(spark, tmp_path, monkeypatch):
    path = tmp_path / "v.txt"
    path.write_text("sour,far too sweet,bitter\nmild,isn't hot\n\n\n a , b\nc\n", encoding="utf-8")
    rows = lexicons.read_lexicon(spark, str(path), ["x", "y"]).collect()
    assert [(r["class_id"], r["word_pos"], r["word"]) for r in rows] == [
        (0, 0, "sour"), (0, 1, "far too sweet"), (0, 2, "bitter"), (1, 0, "mild"), (1, 1, "isn't hot"),
    ]
    second = lexicons.read_lexicon(spark, str(path), choice=1).collect()
    assert [(r["class_id"], r["word"]) for r in second] == [(0, "a "), (0, " b"), (1, "c")]
    with pytest.raises(ValueError, match="2 classes, expected 3"):
        lexicons.read_lexicon(spark, str(path), ["x", "y", "z"])
    monkeypatch.setattr(lexicons, "MAX_FILE_BYTES", 10)
    with pytest.raises(Exception, match="too large for a lexicon"):
        lexicons.read_lexicon(spark, str(path)).collect()
    monkeypatch.undo()
    counts = lx.words_per_class(lexicons.read_lexicon(spark, str(path))).collect()
    assert {r["class_id"]: r["n_words"] for r in counts} == {0: 3, 1: 2}


def test_word_sets_file(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('[\n {"Harbour": ["boat"],\n "Garden": ["hedge"]},\n {"Harbour": ["boat", "quay"]}\n]')
    rows = lexicons.read_word_sets(spark, str(path)).collect()
    assert {(r["choice"], r["class_name"], r["word_pos"], r["word"]) for r in rows} == {
        (0, "Harbour", 0, "boat"), (0, "Garden", 0, "hedge"), (1, "Harbour", 0, "boat"), (1, "Harbour", 1, "quay"),
    }


def test_clean_text_file(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("a,b,c\nabc\n\nx,y\n", encoding="utf-8")
    sinks.clean_text_file(spark, str(path), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a，b,c", "abc", "", "x,y"]


def test_append(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.createDataFrame([("x", "a, b")], "cyberbullying_type string, tweet_text string")
    sinks.append_rows(df, path, "csv", first=True)
    sinks.append_rows(df, path, "csv")
    assert labeled.read_csv_strings(spark, path, df.columns, header=True).count() == 2
    sinks.append_rows(df, path, "csv", first=True)
    got = labeled.read_csv_strings(spark, path, df.columns, header=True).collect()
    assert [tuple(r) for r in got] == [("x", "a, b")]


def test_run_record(spark, tmp_path):
    metrics = fs.evaluate(predictions(spark, [1, 0], [1, 0]))
    config = {"dataset": "tweets", "template_id": 0, "seed": 142}
    path = str(tmp_path / "runs")
    for _ in range(2):
        sinks.write_run_record(config, metrics, path)
    assert spark.read.parquet(path).count() == 2
    text = sinks.record_text(sinks.run_record(config, metrics)).first()["record"]
    assert text == (
        "=" * 20 + "\ndataset tweets\ttemp 0\tseed 142\t \n"
        "Acc: 1.0\tRMSE: 0.0\tMAE: 0.0\tPRECISION: 1.0\tRECALL: 1.0\tF1 Score: 1.0\n\n"
    )


def test_entropy_of_uniform_scores_is_finite(spark):
    row = spark.range(1).select(density_mode(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.5)))).first()
    assert math.isfinite(row[0])


def test_broadcast_by_rows_and_bytes(spark, monkeypatch):
    df = spark.range(100).select("id", F.lit("x" * 1000).alias("wide"), F.array(F.lit("y" * 1000)).alias("list"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(skew.broadcast_if_small(df)[0]) and not hinted(skew.broadcast_if_small(df, 99)[0])
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 150_000)
    assert not hinted(skew.broadcast_if_small(df)[0]) and hinted(skew.broadcast_if_small(df.select("id"))[0])


@pytest.mark.parametrize("calibrate", [False, True])
def test_few_shot_run_rates_every_row(spark, tmp_path, calibrate):
    """Copies of a test row count as often as they occur, and copies of a train row are sampled one by one."""
    known = catalog.find_dataset("ToxiGen")
    train = [(0, "calm day")] * 5 + [(1, "bad day"), (0, "day of rain")]
    test = [(1, "bad words")] * 6 + [(0, "bad luck"), (0, "calm sea"), (0, "calm sea"), (1, "calm lake")]
    for split, rows in (("train", train), ("test", test)):
        sinks.write_labeled_csv(spark.createDataFrame(rows, "label int, text string"), f"{tmp_path}/{known.folder}/{split}.csv")
    scripts = f"{tmp_path}/{known.scripts}"
    sinks.write_log_lines(spark.createDataFrame([('{"placeholder": "text_a"} It was {"mask"} .',)], "value string"), f"{scripts}/manual_template.txt")
    sinks.write_log_lines(spark.createDataFrame([("abuse\nkind",)], "value string"), f"{scripts}/manual_verbalizer.txt")

    def word_logit(prompt, word):
        return F.when(prompt.startswith("bad") == (word == "abuse"), 9.0).otherwise(0.0)

    record = classify.few_shot_run(spark, str(tmp_path), str(tmp_path), "ToxiGen", word_logit, shots=2, calibrate=calibrate).first()
    assert (record["accuracy"], record["precision"], record["recall"]) == pytest.approx((8 / 10, 6 / 7, 6 / 7))
