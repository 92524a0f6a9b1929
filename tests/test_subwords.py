"""Sub-word budgets against the tokenizer's own encoding, and label words of several pieces."""

import json

import pytest
from pyspark.sql import functions as F

from augspark.functions.subwords import Pieces, Subwords
from augspark.operators import lexicon as lx
from augspark.plans import classify, text_queries


@pytest.fixture(scope="module")
def path():
    return text_queries.vocabulary_path()


@pytest.fixture(scope="module")
def plain(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


TEXTS = [
    "", " ", "one", "  two  blanks and\ttabs\n\nlines ", "I'll say it's don't 12345 3.14!!! ...", "naïve café – “quotes” ünïcödé",
    "日本語のテキスト 中文字符", "emoji 👩‍👩‍👧 and 𝔘𝔫𝔦", "a" * 500, "word " * 300, "   mixed\r\nends", "<|endoftext|> is plain here",
]


def cut(plain, text, budget, side):
    """The longest start or end of whole characters whose bytes lie in the kept tokens."""
    sizes = [len(t) for t in plain.encode(text, add_special_tokens=False).tokens]
    data = text.encode()
    assert sum(sizes) == len(data)
    if side == "first":
        return data[: sum(sizes[:budget])].decode("utf-8", "ignore")
    return data[len(data) - sum(sizes[max(len(sizes) - budget, 0) :]) :].decode("utf-8", "ignore")


def test_pieces_are_those_of_the_tokenizer(path, plain):
    plain.encode_special_tokens = True
    pieces = Pieces(open(path, encoding="utf-8").read())
    for text in TEXTS * 2:  # the second time from memory
        assert pieces.ids(text) == plain.encode(text, add_special_tokens=False).ids
        for budget in (0, 1, 2, 7, 100):
            for side in ("first", "last"):
                assert pieces.truncated(text, budget, side) == cut(plain, text, budget, side)


def test_texts_of_a_table(spark, path, plain):
    plain.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80)
    rows = [(r["text"], i % 40) for i, r in enumerate(docs.collect())] + [(t, 3) for t in TEXTS] + [(None, 3), ("some text", None)]
    df = spark.createDataFrame(rows, "text string, budget int").repartition(3)
    tokenizer = Subwords(spark, path)
    found = df.select(
        "text",
        "budget",
        tokenizer.count(F.col("text")).alias("n"),
        tokenizer.ids(F.col("text")).alias("ids"),
        tokenizer.truncate(F.col("text"), F.col("budget")).alias("head"),
        tokenizer.truncate(F.col("text"), F.col("budget"), "last").alias("tail"),
    ).collect()
    for text, budget, n, ids, head, tail in found:
        if text is None:
            assert (n, ids, head, tail) == (None, None, None, None)
            continue
        want = plain.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), want)
        if budget is None:
            assert (head, tail) == (None, None)
        else:
            assert (head, tail) == (cut(plain, text, budget, "first"), cut(plain, text, budget, "last"))
    with pytest.raises(ValueError, match="side"):
        tokenizer.truncate(F.col("text"), 3, "middle")


def test_a_tokenizer_that_changes_texts_is_refused(spark, path, tmp_path):
    with pytest.raises(ValueError, match="without normalizer"):
        Subwords(spark, text_queries.vocabulary_path("word_bpe_49k.json"))
    changed = json.load(open(path, encoding="utf-8"))
    changed["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="not the bytes"):
        Pieces(json.dumps(changed)).ids("word")


def test_prompts_keep_to_the_budget(spark, path, plain):
    template = '{"placeholder": "text_a"} It was {"mask"} .'
    rows = spark.createDataFrame([(0, "short"), (1, "word " * 500), (2, "ünïcödé " * 90), (3, "")], "id int, text string")
    tokenizer = Subwords(spark, path)
    frame = len(plain.encode(" It was [MASK] .").ids)
    prompts = {r["id"]: r["prompt"] for r in classify.classification_prompts(rows, template, max_tokens=40, tokenizer=tokenizer, special_tokens=2).collect()}
    assert prompts[0] == "short It was [MASK] ." and prompts[3] == " It was [MASK] ."
    for i in (1, 2):
        assert prompts[i].endswith(" It was [MASK] .")
        kept = prompts[i].removesuffix(" It was [MASK] .")
        assert len(plain.encode(kept).ids) in (38 - frame, 37 - frame)
        assert rows.where(F.col("id") == i).first()["text"].startswith(kept)
    tight = classify.classification_prompts(rows, template, max_tokens=3, tokenizer=tokenizer).where("id = 1").first()["prompt"]
    assert tight == " It was [MASK] ."


def test_label_words_of_several_pieces(spark, path, plain):
    rows = [("good", 1), ("unbelievableness", 1), ("bad", 0), ("", 0)]
    lexicon = spark.createDataFrame(rows, "word string, class_id int")
    tokenizer = Subwords(spark, path)
    pieces = {w: tuple(plain.encode(" " + w).ids) for w, _ in rows}
    every = lx.split_words(lexicon, tokenizer)
    assert {r["word"]: tuple(r["pieces"]) for r in every.collect()} == pieces
    assert len(pieces["unbelievableness"]) > 2
    kept = lx.split_words(lexicon, tokenizer, max_token_split=2)
    assert sorted(r["word"] for r in kept.collect()) == ["", "bad", "good"]
    assert lx.collect_lexicon(kept).words == (pieces[""], pieces["bad"], pieces["good"])


@pytest.mark.parametrize("pool,pick", [("first", lambda x: x[0]), ("max", max), ("mean", lambda x: sum(x) / len(x))])
def test_pooled_scores(spark, pool, pick):
    rows = [((0,), (2, 3), (5, 1, 4)), ([0.5, -1.0, 2.0, 3.5, 9.0, 4.0],)]
    lexicon = lx.LexiconArrays(rows[0], (0, 0, 1), (0.0, 0.0, 0.0), pool)
    df = spark.createDataFrame([rows[1]], "logits array<double>")
    found = df.select(lx.lexicon_logits(F.col("logits"), lexicon).alias("x")).first()["x"]
    assert found == [pick([rows[1][0][i] for i in word]) for word in rows[0]]
    with pytest.raises(ValueError, match="pooled by"):
        lx.lexicon_logits(F.col("logits"), lx.LexiconArrays(rows[0], (0, 0, 1), (0.0,) * 3, "sum"))


def test_words_without_pieces_are_left_out(spark):
    df = spark.createDataFrame([("a", 0, [1]), ("b", 1, []), ("c", 1, None), ("d", 1, [2, 3])], "word string, class_id int, pieces array<int>")
    assert lx.collect_lexicon(df).words == ((1,), (2, 3))
