import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def tokenizer_file():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest size, as rows."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, run int, score double, key string"


@pytest.fixture(scope="session")
def odd_documents(spark, documents):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, columns with clashing names."""
    texts = [t for _, t, _, _ in documents[:12]]
    long_text = " ".join(texts) * 12 + " " + "é" * 9000 + " " + "ab" * 3000
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(20, None, None, None), (21, "", "en", "src0"), (22, " \n\t ", "en", "src1"), (23, long_text, "de", "src2")]
    rows += [(24, texts[0], "en", None), (24, texts[0], "en", None), (25, texts[1], None, "src0"), (25, texts[2], None, "src0")]
    rows += [(None, texts[3], "en", "src1"), (None, None, None, None), (26, "One", "en", "src1"), (27, "one two", "en", "src1")]
    wide = [(*r, len(r[1]) if r[1] else None, "clash", 7, 0.5, None) for r in rows]
    return spark.createDataFrame(wide, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(12)] + [(None, 1, 1), (3, None, None), (99, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
