"""Conversations of very different lengths: one with a third of all turns, null keys, bounds on one value."""

import pytest
from pyspark.sql import functions as F

from augspark.operators import chats


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} é") for c in range(40) for t in range(10)]
    rows += [(99, t, "user", f"hot {t}") for t in range(200)] + [(None, t, "user", f"null {t}") for t in range(30)]
    rows += [(5, 3, "user", None), (5, 3, None, "no role")]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(chats, "MAX_CHAT_TURNS", 20)
    monkeypatch.setattr(chats, "PART_TURNS", 7)


def by_key(rows):
    return sorted((repr(r["conv_id"]), r["part"], r["rendered"]) for r in rows.collect())


@pytest.mark.parametrize("reply", [False, True])
def test_long_conversations_are_rendered_alike(turns, tiny, monkeypatch, reply):
    def run():
        return by_key(chats.with_reply(turns, F.concat(F.lit("yes "), "conv_id")) if reply else chats.render_conversations(turns))

    found = run()
    monkeypatch.undo()
    assert found == run() and len(found) == 42 and {part for _, part, _ in found} == {0}


def test_long_conversations_are_cut_evenly(turns, tiny):
    """No group of turns that becomes one value is larger than a part."""
    hot = turns.where("conv_id = 99 or conv_id is null")
    sizes = [len(r["messages"]) for r in chats.chat_parts(hot, chats.PART_TURNS).collect()]
    assert max(sizes) <= 7 and sum(sizes) == 230


def test_conversations_beyond_one_value_stay_in_parts(turns, tiny, monkeypatch):
    whole = {k: text for k, _, text in by_key(chats.with_reply(turns, F.lit("yes")))}
    monkeypatch.setattr(chats, "MAX_CHAT_BYTES", 2000)
    found = by_key(chats.with_reply(turns, F.lit("yes")))
    hot = [text for _, _, text in sorted((p, k, t) for k, p, t in found if k == "99")]
    assert len(hot) == 29 and "".join(hot) == whole["99"]
    assert [(k, p, t) for k, p, t in found if k != "99"] == [(k, 0, whole[k]) for k, _, _ in found if k != "99"]


def test_long_texts_count_too(spark, monkeypatch):
    monkeypatch.setattr(chats, "MAX_CHAT_BYTES", 1000)
    rows = [(1, t, "user", "x" * 600) for t in range(3)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    monkeypatch.setattr(chats, "PART_TURNS", 1)
    assert [(k, p) for k, p, _ in by_key(chats.render_conversations(df))] == [("1", 0), ("1", 1), ("1", 2), ("2", 0)]


def test_no_turns(turns):
    assert chats.render_conversations(turns.where("false")).collect() == []
