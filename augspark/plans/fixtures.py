"""Inputs derived from the given tables, as DataFrames and as SQL, and stub text generators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.functions.scoring import softmax
from augspark.operators.generate import fan_out

SEED = 144
SAMPLES = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fx_labeled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    return table(spark, sf, "documents").select("doc_id", "text", "lang").join(labels, "doc_id")


FX_LABELED = """fx_labeled as (
  select d.doc_id, d.text, d.lang, l.toxic as label, l.quality from documents d join labels l on d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def tokens_of(spark: SparkSession, sf: str, size: int, value: str) -> DataFrame:
    """Vectors as tokens of samples of ``size`` tokens each."""
    return vectors(spark, sf).select(
        F.floor(F.col("vec_id") / size).alias("sample_id"),
        (F.col("vec_id") % size).alias("pos"),
        F.col("vec").alias(value),
    )


def fx_spans(tokens: DataFrame, start: int, end: int) -> DataFrame:
    return tokens.select("sample_id").distinct().withColumns({"start": F.lit(start), "end": F.lit(end)})


def fx_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Two heads of four tokens per sample; attention rows are softmaxed vectors."""
    v = F.col("vec_id")
    return vectors(spark, sf).select(
        F.floor(v / 8).alias("sample_id"),
        F.lit(0).alias("layer"),
        F.floor((v % 8) / 4).alias("head"),
        (v % 4).alias("pos"),
        softmax(F.col("vec")).alias("row"),
    )


FX_ATTENTION = """e as (select vec_id, generate_subscripts(embedding, 1) - 1 as j, exp(unnest(embedding)::double) as ex from embeddings),
  fx_attention as (
    select vec_id // 8 as sample_id, (vec_id % 8) // 4 as head, vec_id % 4 as pos,
           sum(ex) filter (where j = vec_id % 4) / sum(ex) as own
    from e group by vec_id)"""


def total(vec: Column) -> Column:
    """Sum of a vector, a score that depends on all of it."""
    return F.aggregate(vec.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)


TOTAL_SQL = "list_sum(embedding::double[])"


def fx_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Five scored candidates per input; some scores failed, some inputs have one valid score or none."""
    v, key, idx = F.col("vec_id"), F.floor(F.col("vec_id") / 5), F.col("vec_id") % 5
    failed = (v % 11 == 0) | ((key % 10 == 0) & (idx != 3)) | (key % 10 == 5)
    score = F.when(failed, F.lit(float("inf"))).otherwise(F.round(total(F.col("vec")), 6))
    return vectors(spark, sf).select(
        key.alias("input_key"),
        idx.alias("sample_idx"),
        score.alias("score"),
        F.concat(F.lit("candidate "), v.cast("string")).alias("text"),
    )


# The steps from scored candidates (input_key, sample_idx, text, score) to the best one of each input
BEST_SQL = """moments as (
  select input_key, count(*) as n, stddev_pop(score) as sd, min(score) as lo, max(score) as hi
  from fx_candidates where score < 'inf'::double group by input_key),
widths as (
  select *, case when bw < 1e-6 then 0.1 else bw end as bandwidth from (
    select *, case when sd > 1e-6 then pow(4 * pow(sd, 5) / (3 * n), 0.2) else 0.1 end as bw from moments)),
grid as (
  select w.*, k, lo - 0.5 * sd + k * ((hi + 0.5 * sd) - (lo - 0.5 * sd)) / 499 as x
  from widths w cross join range(500) r(k) where n > 1),
density as (
  select g.input_key, k, x, sum(exp(-0.5 * pow((x - c.score) / bandwidth, 2))) as dn
  from grid g join fx_candidates c on c.input_key = g.input_key and c.score < 'inf'::double
  group by g.input_key, k, x),
modes as (
  select input_key, x as mode from (
    select *, row_number() over (partition by input_key order by dn desc, k) as r from density) where r = 1),
best as (
  select * from (
    select c.*, m.mode, row_number() over (partition by c.input_key order by
             case when c.score = 'inf'::double then c.score when m.mode is null then c.score else abs(c.score - m.mode) end,
             c.sample_idx) as r
    from fx_candidates c left join modes m on m.input_key = c.input_key) where r = 1)"""

FX_CANDIDATES = f"""fx_candidates as (
  select vec_id // 5 as input_key, vec_id % 5 as sample_idx, 'candidate ' || vec_id as text,
         case when vec_id % 11 = 0 or ((vec_id // 5) % 10 = 0 and vec_id % 5 <> 3) or (vec_id // 5) % 10 = 5
              then 'inf'::double else round({TOTAL_SQL}, 6) end as score
  from embeddings),
{BEST_SQL}"""


def fx_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score for each of the five samples of every labelled document."""
    vecs = table(spark, sf, "embeddings")
    scores = vecs.select("vec_id", F.round(total(F.col("embedding")), 6).alias("svd_score"))
    samples = fan_out(table(spark, sf, "labels").select("doc_id"), SAMPLES)
    vec_id = (F.col("doc_id") * SAMPLES + F.col("sample_idx")) % vecs.agg(F.count("*")).scalar()
    return samples.withColumn("vec_id", vec_id).join(scores, "vec_id").select("doc_id", "sample_idx", "svd_score")


def fx_word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of 64 words for every example."""
    return vectors(spark, sf).select(F.col("vec_id").alias("example"), F.posexplode("vec").alias("word", "logit"))


FX_WORD_SCORES = """fx_word_scores as (
  select vec_id as example, generate_subscripts(embedding, 1) - 1 as word, unnest(embedding)::double as logit from embeddings)"""


def fx_lexicon(spark: SparkSession) -> DataFrame:
    """40 label words in 10 classes."""
    return spark.range(40).select(
        F.col("id").cast("int").alias("word"),
        (F.col("id") % 10).cast("int").alias("class_id"),
        (F.col("id") % 3).cast("double").alias("weight"),
    )


FX_LEXICON = "fx_lexicon as (select r as word, r % 10 as class_id, (r % 3)::double as weight from range(40) t(r))"


# -- generators ---------------------------------------------------------------------------------


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def stub_text(prompt: str, number: int) -> str:
    """Depends on the whole prompt, also where only its first sentence is kept."""
    return f"aug {digest(prompt)}: {prompt} #{number}"


def stub_factory():
    """Deterministic stand-in for a language model."""
    return lambda prompts, sample_idx, **options: [stub_text(p, i) for p, i in zip(prompts, sample_idx)]


def failing_factory():
    """The same, but failing on prompts whose length is a multiple of seven."""

    def generate(prompts, sample_idx, **options):
        if any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("model failed")
        return [stub_text(p, i) for p, i in zip(prompts, sample_idx)]

    return generate


def varied_length(number: int) -> int:
    return 8 + (number * number * 3) % 17


def varied_factory():
    """Generator whose samples depend on the whole prompt and differ in length."""

    def generate(prompts, sample_idx, **options):
        return [digest(p) + "x" * varied_length(i) for p, i in zip(prompts, sample_idx)]

    return generate


def varied_sql(prompt: str, number: str) -> str:
    return f"concat(md5({prompt}), repeat('x', (8 + ({number} * {number} * 3) % 17)::integer))"


def echo_factory():
    """Answers a flat prompt as models do: with the prompt, and a turn that repeats its last input."""

    def generate(prompts, sample_idx, **options):
        inputs = [p.rpartition("Input: ")[2].partition("<|eot_id|>")[0] for p in prompts]
        return [f"{p}{given} [{digest(p)}]<|eot_id|>\nmore" for p, given in zip(prompts, inputs)]

    return generate


def length_scorer():
    """Scorer that returns the length of a conversation."""
    return lambda prompts: [float(len(p)) for p in prompts]


def whole_prompt(text: Column) -> Column:
    """Prompt builder of the stubs: the text itself."""
    return text


def stub_sql(prompt: str, number: str) -> str:
    return f"concat('aug ', md5({prompt}), ': ', {prompt}, ' #', {number}::varchar)"


_BLANK = r"[\s\x0b\x1c-\x1f\x85\pZ]+"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A{_BLANK}|{_BLANK}\z', '', 'g')"


def first_sentence_sql(text: str) -> str:
    clean = strip_sql(f"replace({text}, '<|im_end|>', '')")
    return (
        f"case when contains({clean}, '.') then split_part(split_part({clean}, chr(10), 1), '.', 1) || '.' "
        f"else {clean} end"
    )
