"""Text functions on many random strings, against plain Python definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from augspark.functions import prompts, text as tx

PIECES = [
    "a", "b c", ",", "，", ".", "\n", "\r", "\r\n", " ", "\t", " ", "　", "\x1c", "\x85", "ß", "某人", "é", "😀",
    "Augmented: ", "Augmented:", "<|eot_id|>", "<|im_end|>", "<|im_end", "USERNAME", '"', "\\", "$1", "{", "}",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(3000)]


def commas(text):
    *head, tail = re.sub(r"[\r\n]+\Z", "", text).split(",")
    return "，".join(head) + "," + tail if head else tail


def completion(text):
    _, marker, after = text.rpartition("Augmented: ")
    return after.partition("<|eot_id|>")[0].strip() if marker else text.strip()


def sentence(text):
    clean = "".join(text.split("<|im_end|>")).strip()
    return re.match(r"[^\n.]*", clean).group() + "." if "." in clean else clean


CASES = {
    "clean_commas": (tx.clean_commas, commas),
    "extract_completion": (tx.extract_completion, completion),
    "first_sentence": (tx.first_sentence, sentence),
    "strip": (tx.strip, str.strip),
    "truncate": (lambda c: tx.truncate_chars(c, 5), lambda t: t[:5]),
    "mask": (tx.replace_user_mask, lambda t: t.replace("USERNAME", "某人")),
    "flat_prompt": (
        lambda c: prompts.flat_prompt(c, "s", []),
        lambda t: f"{prompts.flat_prompt_frame('s', [])[0]}{t}{prompts.flat_prompt_frame('s', [])[1]}",
    ),
    "first_words": (lambda c: tx.truncate_tokens(c, 2), lambda t: " ".join(re.split(r"[ \t\n\x0b\f\r]+", t.strip())[:2])),
    "last_words": (
        lambda c: tx.truncate_tokens(c, 2, "last"),
        lambda t: " ".join(re.split(r"[ \t\n\x0b\f\r]+", t.strip())[-2:]),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_random_texts(spark, texts, name):
    column, plain = CASES[name]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("got"))
    wrong = [(texts[r["i"]], r["got"], plain(texts[r["i"]])) for r in df.collect() if r["got"] != plain(texts[r["i"]])]
    assert wrong == []
