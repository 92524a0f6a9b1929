"""Hand-sized values of the text, prompt and template functions."""

import pytest
from pyspark.sql import functions as F

from augspark.functions import prompts, templates, text as tx


def apply(spark, function, *values, type="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {type}")
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


def test_clean_commas(spark):
    got = apply(spark, tx.clean_commas, "a,b,c", "abc", "a,b", "a,b,c\r\n", ",,", None)
    assert got == ["a，b,c", "abc", "a,b", "a，b,c", "，,", None]
    assert apply(spark, lambda c: tx.clean_commas(tx.clean_commas(c)), "a,b,c") == ["a，b,c"]


def test_strip_equals_python(spark):
    values = [" 　a b \n", "\x1c\x1d x \x85", "", " ", "\xa0y\xa0", "a"]
    assert apply(spark, tx.strip, *values) == [v.strip() for v in values]


def test_extract_completion(spark):
    got = apply(
        spark,
        tx.extract_completion,
        "Augmented: a<|eot_id|> Augmented:  b c <|eot_id|>zz",
        "zz<|eot_id|>",
        " Augmented: ",
        "Augmented: x",
    )
    assert got == ["b c", "zz<|eot_id|>", "", "x"]


def test_first_sentence(spark):
    got = apply(spark, tx.first_sentence, "a.b", "x\ny.z", " no dot\nl2 <|im_end|>", "a\r\nb.c", ".", "")
    assert got == ["a.", "x.", "no dot\nl2", "a\r.", ".", ""]


def test_class_index(spark):
    classes = ["cyberbullying", "not_cyberbullying"]
    assert apply(spark, lambda c: tx.class_index(c, classes), "not_cyberbullying", "cyberbullying") == [1, 0]
    assert apply(spark, lambda c: tx.class_index(c, classes, strict=False), "x", None) == [None, None]
    with pytest.raises(Exception, match="unknown class: x"):
        apply(spark, lambda c: tx.class_index(c, classes), "x")


def test_int_label(spark):
    assert apply(spark, tx.int_label, "1", "0") == [1, 0]
    assert apply(spark, lambda c: tx.int_label(c, strict=False), "1", "x") == [1, None]
    assert apply(spark, tx.is_odd_label, 0, 1, 2, type="int") == [False, False, True]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply(spark, tx.int_label, "x")


def test_truncate_tokens(spark):
    text = " a  b\tc d "
    assert apply(spark, lambda c: tx.truncate_tokens(c, 2, "first"), text, "", "a") == ["a b", "", "a"]
    assert apply(spark, lambda c: tx.truncate_tokens(c, 2, "last"), text, "", "a") == ["c d", "", "a"]
    characters = lambda c: F.split(c, "")
    assert apply(spark, lambda c: tx.truncate_tokens(c, 3, tokenizer=characters, joiner=""), "abcdef") == ["abc"]
    with pytest.raises(ValueError):
        tx.truncate_tokens(F.lit("a"), 1, "middle")


def test_flat_prompt(spark):
    (got,) = apply(spark, lambda c: prompts.flat_prompt(c, "SYS", [("q", "r")]), "IN")
    head = "<|start_header_id|>{}<|end_header_id|>\n\n"
    assert got == (
        "<|begin_of_text|>" + head.format("system") + "SYS<|eot_id|>\n"
        + head.format("user") + "Input: q<|eot_id|>\n"
        + head.format("assistant") + "Augmented: r<|eot_id|>\n"
        + head.format("user") + "Input: IN<|eot_id|>\n"
        + head.format("assistant") + "Augmented: "
    )
    assert len(prompts.EXAMPLES) == 5


def test_chat(spark):
    (messages,) = apply(spark, lambda c: prompts.chat_messages(c, "zh"), "hi")
    assert [m["role"] for m in messages] == ["system"] + ["user", "assistant"] * 5 + ["user"]
    assert messages[0]["content"] == prompts.SYSTEM_CHINESE
    assert messages[-1]["content"] == "hi"
    (shown,) = apply(spark, lambda c: prompts.render_chat(prompts.append_reply(prompts.single_message(c), F.lit("r"))), "p")
    assert shown == "user\npassistant\nr"
    (shown,) = apply(spark, lambda c: prompts.render_chat(prompts.single_message(c), open_reply=True), "p")
    assert shown == "user\npassistant\n"


@pytest.mark.parametrize(
    "template, expected",
    [
        ('A {"placeholder": "text_a"} comment : {"mask"}', "A X comment : [MASK]"),
        (' {"placeholder": "text_a"}  The subject here is {"mask"} .', " X The subject here is [MASK] ."),
        (' [ Category : {"mask"} ] {"placeholder": "text_a"}', " [ Category : [MASK] ] X"),
        ('{"placeholder": "text_a"} {"special": "<sep>"} is {"mask"}.', "X <sep> is [MASK]."),
        ('{"placeholder": "text_a"},{"placeholder": "text_b"}, so', "X,Y, so"),
        ('{"soft"} news {"soft"} {"mask"}', "<soft> news <soft> [MASK]"),
        ('{"soft":"This"} topic {"soft":None,"duplicate":2}', "This topic <soft><soft>"),
        ("two  words  ", "two  words"),
    ],
)
def test_template(spark, template, expected):
    columns = {"text_a": F.lit("X"), "text_b": F.lit("Y")}
    row = spark.range(1).select(templates.render_template(template, columns)).first()
    assert row[0] == expected


def test_template_errors():
    with pytest.raises(ValueError, match="text_c"):
        templates.render_template('{"placeholder": "text_c"}', {"text_a": F.lit("")})
    with pytest.raises(ValueError, match="unknown template slot"):
        templates.parse_template('{"other": 1}')
    with pytest.raises(ValueError, match="bad template slot"):
        templates.parse_template("{__import__('os')}")


def test_read_template(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("first\n second {\"mask\"} \n", encoding="utf-8")
    assert templates.read_template(spark, str(path), 1) == ' second {"mask"}'
    with pytest.raises(ValueError):
        templates.read_template(spark, str(path), 7)


def test_choices(spark):
    choices = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in (("a", "yes"), ("b", "no"))])
    row = spark.range(1).select(templates.worked_example_prompt("EX", F.lit("q?"), choices)).first()
    assert row[0] == "EX\n\nQ: q?\nAnswer Choices:\n(a) yes|(b) no\nA: [MASK]"
