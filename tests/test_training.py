"""Learned label-word weights: gradients, steps, epochs, and runs that are started again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augspark.operators import lexicon as lx, word_weights as ww
from augspark.plans import training

LEXICON = lx.LexiconArrays((0, 2, 3, 5, 6), (0, 0, 1, 1, 1), (0.3, -0.2, 0.0, 0.5, 1.0))


def plain_logs(logits):
    own = logits[:, LEXICON.words]
    p = np.exp(own - own.max(1, keepdims=True))
    return np.log(p / p.sum(1, keepdims=True) + 1e-15)


def plain_scores(logs, weights, temperature=1.0):
    classes = np.array(LEXICON.classes)
    out = []
    for c in range(2):
        own = classes == c
        e = np.exp(temperature * weights[own])
        out.append(logs[:, own] @ (e / e.sum()))
    return np.stack(out, axis=1)


def plain_loss(logs, labels, weights, temperature=1.0):
    s = plain_scores(logs, weights, temperature)
    return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).sum())


def plain_gradient(logs, labels, weights, temperature=1.0, h=1e-6):
    """By finite differences."""
    out = []
    for i in range(len(weights)):
        step = np.eye(len(weights))[i] * h
        out.append((plain_loss(logs, labels, weights + step, temperature) - plain_loss(logs, labels, weights - step, temperature)) / (2 * h))
    return np.array(out)


def made(seed, n):
    """Scores in which one word of each class tells the label and the others say nothing."""
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 2, n)
    logits = rng.normal(0, 1, (n, 8))
    logits[:, 2] += 1.5 * (labels == 0)
    logits[:, 5] += 1.5 * (labels == 1)
    return logits, labels


def frame(spark, logits, labels, first=0):
    rows = [(first + i, int(y), x) for i, (x, y) in enumerate(zip(logits.tolist(), labels, strict=True))]
    return spark.createDataFrame(rows, "example bigint, label int, logits array<double>").repartition(3)


@pytest.mark.parametrize("temperature", [1.0, 2.5])
def test_gradient_equals_finite_differences(spark, temperature):
    logits, labels = made(1, 40)
    rows = frame(spark, logits, labels).select("label", ww.word_logs(LEXICON).alias("log_p"))
    odd = rows.limit(2).select(F.lit(7).alias("label"), "log_p").union(rows.limit(1).select(F.lit(None).cast("int"), "log_p"))
    weights = np.array(LEXICON.weights)
    found = ww.loss_and_gradient(rows.union(odd), LEXICON, weights, temperature).first()
    logs = plain_logs(logits)
    assert found["n"] == 40, "labels that are no class teach nothing"
    assert found["loss"] == pytest.approx(plain_loss(logs, labels, weights, temperature))
    assert found["gradient"].toArray() == pytest.approx(plain_gradient(logs, labels, weights, temperature), abs=1e-5)
    assert ww.loss_and_gradient(rows.where("false"), LEXICON, weights).collect() == []
    assert ww.fit_step(rows.where("false"), LEXICON, ww.WeightState.of(LEXICON))[2] == 0


def test_every_class_needs_a_word(spark):
    with pytest.raises(ValueError, match="every class"):
        ww.class_scores_of(F.col("log_p"), lx.LexiconArrays((0, 1), (0, 2), (0.0, 0.0)), np.ones(2))


def test_steps_are_cut_and_adapt():
    state = ww.WeightState(np.zeros(2), np.zeros(2), np.zeros(2))
    far = state.stepped(np.array([30.0, 40.0]), rate=0.1)
    assert far.first == pytest.approx([0.06, 0.08]), "the gradient's length is cut to 1"
    assert far.weights == pytest.approx([-0.1, -0.1], rel=1e-3), "the first step is the rate, whatever the gradient"
    assert far.stepped(np.zeros(2)).steps == 2


def plain_training(logits, labels, held_logits, held, epochs, rate=0.06):
    """(weights, loss, accuracy) after each epoch of one step over all rows."""
    logs, held_logs = plain_logs(logits), plain_logs(held_logits)
    w, m, v, out = np.array(LEXICON.weights), np.zeros(5), np.zeros(5), []
    for t in range(1, epochs + 1):
        g = plain_gradient(logs, labels, w) / len(labels)
        g = g / max(1.0, np.sqrt((g * g).sum()))
        loss = plain_loss(logs, labels, w) / len(labels)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-6)
        out.append((w, loss, float((plain_scores(held_logs, w).argmax(1) == held).mean())))
    return out


def test_training_equals_an_independent_fit_and_beats_fixed_weights(spark, tmp_path):
    (x, y), (hx, hy), (tx, ty) = made(2, 60), made(3, 200), made(4, 600)
    path = str(tmp_path / "run")
    table = training.train_words(frame(spark, x, y), frame(spark, hx, hy, 1000), LEXICON, path, epochs=25, batch_size=None)
    rows = sorted(table.collect(), key=lambda r: r["epoch"])
    want = plain_training(x, y, hx, hy, 25)
    assert [r["val_acc"] for r in rows] == pytest.approx([w[2] for w in want])
    assert [r["loss"] for r in rows] == pytest.approx([w[1] for w in want], abs=1e-4)
    last = training.word_weights(spark, path, 24).orderBy("class_id", "word").collect()
    assert [r["weight"] for r in last] == pytest.approx(want[-1][0], abs=1e-3)
    best = training.trained_lexicon(spark, path, LEXICON)
    top = max(r["val_acc"] for r in rows)
    chosen = max(r["epoch"] for r in rows if r["val_acc"] == top)
    assert best.weights == pytest.approx(want[chosen][0], abs=1e-3)

    def accuracy(lexicon):
        scored = lx.class_score_arrays(frame(spark, tx, ty), lexicon, temperature=1.0)
        return scored.agg(F.avg((lx.predicted_class(F.col("class_scores")) == F.col("label")).cast("int"))).first()[0]

    assert accuracy(best) > accuracy(LEXICON)


class Killed(Exception):
    pass


@pytest.mark.parametrize("batch_size", [None, 7])
def test_a_killed_run_ends_with_the_same_epochs(spark, tmp_path, batch_size, monkeypatch):
    (x, y), (hx, hy) = made(5, 20), made(6, 30)

    def run(name, **settings):
        train, held = frame(spark, x, y), frame(spark, hx, hy, 1000)
        return training.train_words(train, held, LEXICON, str(tmp_path / name), epochs=4, batch_size=batch_size, **settings)

    whole = [tuple(r) for r in run("whole").orderBy("epoch").collect()]
    assert [r[0] for r in whole] == [0, 1, 2, 3] and {r[2] for r in whole} == {20}

    def kill(epoch):
        if epoch == 1:
            raise Killed

    with pytest.raises(Killed):
        run("killed", after_epoch=kill)
    assert training.epoch_table(spark, str(tmp_path / "killed")).count() == 2
    # ... and again between the weights of an epoch and its rating
    with monkeypatch.context() as patch:
        patch.setattr(training, "evaluate", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            run("killed")
    assert training.epoch_table(spark, str(tmp_path / "killed")).count() == 2
    again = [tuple(r) for r in run("killed").orderBy("epoch").collect()]
    assert [r[0] for r in again] == [0, 1, 2, 3]
    for a, b in zip(again, whole, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    # a finished run is only read
    assert run("killed", after_epoch=kill).count() == 4


def test_no_rated_epoch(spark, tmp_path):
    path = str(tmp_path / "none")
    assert training.epoch_table(spark, path).collect() == []
    with pytest.raises(ValueError, match="no rated epoch"):
        training.trained_lexicon(spark, path, LEXICON)
