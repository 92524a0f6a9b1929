"""Queries over label words."""

from __future__ import annotations

from pyspark.sql import functions as F

from augspark.operators import fewshot as fs, lexicon as lx
from augspark.plans import label_words
from augspark.plans.fixtures import FX_LEXICON, FX_WORD_SCORES, SEED, fx_lexicon, fx_word_scores, vectors
from augspark.plans.registry import query

WORD_TOKENS = 4


def _word_tokens(spark, sf):
    """Four token vectors per word."""
    return vectors(spark, sf).select(
        F.floor(F.col("vec_id") / WORD_TOKENS).alias("word"), F.col("vec_id").alias("pos"), "vec", "label"
    )


POOLED = """
x as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as v from embeddings),
pooled as (select vec_id // 4 as word, j, avg(v) as v, min(vec_id) as pos from x group by 1, 2),
anchors as (select label, j, avg(v) as a from x where label in (0, 1) group by 1, 2),
cosines as (select p.word, a.label, min(p.pos) as pos, sum(p.v * a.a) / (sqrt(sum(p.v * p.v)) * sqrt(sum(a.a * a.a))) as c
            from pooled p join anchors a on a.j = p.j group by 1, 2),
pairs as (select word, min(pos) as pos, max(c) filter (where label = 0) as cos0, max(c) filter (where label = 1) as cos1 from cosines group by 1),
scored as (select *, abs(cos0 - cos1) / sqrt(2.0) as score from pairs)"""


@query(f"with {POOLED} select word, j::bigint as dim, round(v, 6) as value from pooled")
def pooled_word_vectors(spark, sf):
    pooled = lx.pool_words(_word_tokens(spark, sf))
    return pooled.select("word", F.posexplode("vec").alias("dim", "value")).select(
        "word", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )


def _scored(spark, sf):
    anchors = lx.anchor_vectors(vectors(spark, sf), [0, 1])
    return lx.score_words(lx.pool_words(_word_tokens(spark, sf)), anchors)


@query(f"with {POOLED} select word, round(cos0, 6) as cos0, round(cos1, 6) as cos1 from scored")
def word_cosines(spark, sf):
    return _scored(spark, sf).select("word", F.round("cos0", 6).alias("cos0"), F.round("cos1", 6).alias("cos1"))


@query(f"with {POOLED} select word, round(score, 6) as score from scored")
def word_discriminativeness(spark, sf):
    return _scored(spark, sf).select("word", F.round("score", 6).alias("score"))


@query(f"""with {POOLED}, top as (select *, row_number() over (order by score desc, pos) as r from scored)
select string_agg(word::varchar, ',' order by r) as label_words from top where r <= 30""")
def top_label_words(spark, sf):
    top = label_words.discriminative_words(_word_tokens(spark, sf), vectors(spark, sf), [0, 1])
    return lx.word_line(top)


@query("select label as class_id, count(*) as n_words from embeddings group by 1")
def words_per_class(spark, sf):
    return lx.words_per_class(vectors(spark, sf).select("vec_id", F.col("label").alias("class_id")))


SOFTMAX = f"""{FX_WORD_SCORES}, {FX_LEXICON},
matched as (select example, word, class_id, weight, exp(logit - max(logit) over (partition by example)) as e
            from fx_word_scores join fx_lexicon using (word)),
probs as (select *, e / sum(e) over (partition by example) as p from matched)"""

PRIOR = f"""support as (select vec_id as example from embeddings order by md5(concat('{SEED}:', vec_id)), vec_id limit 200),
means as (select word, avg(logit) as m from fx_word_scores join support using (example) group by 1),
lex_means as (select word, exp(m - (select max(m) from means join fx_lexicon using (word))) as e from means join fx_lexicon using (word)),
prior as (select word, e / (select sum(e) from lex_means) as prior from lex_means),
calibrated as (select example, word, class_id, weight, q / sum(q) over (partition by example) as p from (
  select *, p / prior as q from probs join prior using (word)))"""

WEIGHTED = "sum(exp(weight * 2.0) * ln(p + 1e-15)) / sum(exp(weight * 2.0))"


def _support(spark, sf):
    scores = fx_word_scores(spark, sf)
    keys = fs.sample_total(vectors(spark, sf).withColumnRenamed("vec_id", "example"), "example", seed=SEED)
    return scores.join(keys, "example", "left_semi")


def _rounded(scores):
    return scores.select(
        F.col("example"), F.col("class_id").cast("bigint").alias("class_id"), F.round("class_score", 6).alias("class_score")
    )


@query(f"with {SOFTMAX} select example, class_id, round(avg(ln(p + 1e-15)), 6) as class_score from probs group by 1, 2")
def class_scores(spark, sf):
    return _rounded(lx.class_scores(lx.word_probabilities(fx_word_scores(spark, sf), fx_lexicon(spark))))


@query(f"with {SOFTMAX} select example, class_id, round({WEIGHTED}, 6) as class_score from probs group by 1, 2")
def weighted_class_scores(spark, sf):
    probabilities = lx.word_probabilities(fx_word_scores(spark, sf), fx_lexicon(spark))
    return _rounded(lx.weighted_class_scores(probabilities, temperature=2.0))


@query(f"with {SOFTMAX}, {PRIOR} select example, class_id, round(avg(ln(p + 1e-15)), 6) as class_score from calibrated group by 1, 2")
def calibrated_class_scores(spark, sf):
    lexicon = fx_lexicon(spark)
    prior = lx.calibration_prior(_support(spark, sf), lexicon)
    probabilities = lx.word_probabilities(fx_word_scores(spark, sf), lexicon)
    return _rounded(lx.class_scores(lx.calibrated_probabilities(probabilities, prior)))


def _array_scores(scored):
    exploded = scored.select(F.col("vec_id").alias("example"), F.posexplode("class_scores").alias("class_id", "class_score"))
    return _rounded(exploded)


@query(f"with {SOFTMAX} select example, class_id, round({WEIGHTED}, 6) as class_score from probs group by 1, 2")
def weighted_class_scores_from_arrays(spark, sf):
    """One row per example, scored without a shuffle."""
    lexicon = lx.collect_lexicon(fx_lexicon(spark))
    return _array_scores(lx.class_score_arrays(vectors(spark, sf), lexicon, temperature=2.0, logits="vec"))


_PIECES_SQL = "list_transform(range(1 + word % 3), lambda i: (word + 7 * i) % 64)"


@query(f"""with {FX_WORD_SCORES}, {FX_LEXICON},
split as (select word, class_id, weight, unnest({_PIECES_SQL}) as piece from fx_lexicon where 1 + word % 3 <= 2),
pooled as (select s.example, l.word, l.class_id, l.weight, avg(s.logit) as logit from split l join fx_word_scores s on s.word = l.piece group by all),
p as (select *, exp(logit) / sum(exp(logit)) over (partition by example) as p from pooled)
select example, class_id, round(sum(exp(2.0 * weight) * ln(p + 1e-15)) / sum(exp(2.0 * weight)), 6) as class_score from p group by 1, 2""")
def split_word_class_scores(spark, sf):
    """Label words of one to three pieces: those above two pieces go, the others score the mean of their pieces."""
    pieces = F.transform(F.sequence(F.lit(0), F.col("word") % 3), lambda i: ((F.col("word") + 7 * i) % 64).cast("int"))
    split = fx_lexicon(spark).withColumn("pieces", pieces).where(F.size("pieces") <= 2)
    lexicon = lx.collect_lexicon(split, pool="mean")
    return _array_scores(lx.class_score_arrays(vectors(spark, sf), lexicon, temperature=2.0, logits="vec"))


@query(f"with {SOFTMAX}, {PRIOR} select example, class_id, round(avg(ln(p + 1e-15)), 6) as class_score from calibrated group by 1, 2")
def calibrated_class_scores_from_arrays(spark, sf):
    lexicon = lx.collect_lexicon(fx_lexicon(spark))
    rows = vectors(spark, sf)
    support = rows.join(fs.sample_total(rows, "vec_id", seed=SEED), "vec_id", "left_semi")
    prior = lx.array_prior(support, lexicon, "vec")
    return _array_scores(lx.class_score_arrays(rows, lexicon, prior, logits="vec"))


@query(f"""with {SOFTMAX}, s as (select example, class_id, avg(ln(p + 1e-15)) as class_score from probs group by 1, 2),
r as (select *, row_number() over (partition by example order by class_score desc, class_id) as r from s)
select example, class_id as pred from r where r = 1""")
def predicted_classes_from_arrays(spark, sf):
    scored = lx.class_score_arrays(vectors(spark, sf), lx.collect_lexicon(fx_lexicon(spark)), logits="vec")
    return scored.select(F.col("vec_id").alias("example"), lx.predicted_class(F.col("class_scores")).cast("bigint").alias("pred"))


@query(f"""with {SOFTMAX}, {PRIOR},
vocabulary as (select word, row_number() over (order by m, word) as r, count(*) over () as n from means)
select word, class_id from fx_lexicon join vocabulary using (word) where r > floor(n * 0.5)""")
def refined_lexicon(spark, sf):
    refined = lx.refine_lexicon(fx_lexicon(spark), lx.calibration_prior(_support(spark, sf)))
    return refined.select(F.col("word").cast("bigint").alias("word"), F.col("class_id").cast("bigint").alias("class_id"))


@query(f"""with {SOFTMAX}, s as (select example, class_id, avg(ln(p + 1e-15)) as class_score from probs group by 1, 2),
r as (select *, row_number() over (partition by example order by class_score desc, class_id) as r from s)
select example, label, class_id as pred from r join embeddings on vec_id = example where r = 1""")
def predicted_classes(spark, sf):
    preds = label_words.classify_by_words(fx_word_scores(spark, sf), fx_lexicon(spark))
    truth = vectors(spark, sf).select(F.col("vec_id").alias("example"), "label")
    return preds.join(truth, "example").select("example", "label", F.col("pred").cast("bigint").alias("pred"))
