"""Queries over fan-out, generation, uncertainty scores and candidate choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from augspark.operators import generate as gen, select as sel, uncertainty as un
from augspark.functions.prompts import EXAMPLES, SYSTEM_ENGLISH
from augspark.functions.text import truncate_chars
from augspark.functions.scoring import is_valid_score
from augspark.plans import augment, fixtures as fx
from augspark.plans.fixtures import (
    FX_ATTENTION,
    BEST_SQL,
    FX_CANDIDATES,
    FX_LABELED,
    first_sentence_sql,
    fx_candidates,
    fx_labeled,
    strip_sql,
    stub_sql,
    table,
    tokens_of,
)
from augspark.plans.registry import query
from augspark.plans.text_queries import _AFTER, _BEFORE, quoted
from augspark.session import scratch_path

# -- generation ---------------------------------------------------------------------------------


@query(f"with {FX_LABELED} select doc_id, i::integer as sample_idx, substring(text, 1, 500) as prompt from fx_labeled cross join range(5) r(i)")
def fan_out_samples(spark, sf):
    cut = fx_labeled(spark, sf).select("doc_id", truncate_chars(F.col("text")).alias("prompt"))
    return gen.fan_out(cut)


@query(f"""with {FX_LABELED}
select doc_id, 5::bigint as n_samples, md5(concat_ws('|', {", ".join(f"'{i}:{i}#' || text" for i in range(5))})) as joined from fx_labeled""")
def regroup_samples(spark, sf):
    rows = gen.fan_out(fx_labeled(spark, sf).select("doc_id", "text"))
    rows = rows.withColumn("text", F.concat(F.col("sample_idx").cast("string"), F.lit("#"), F.col("text")))
    joined = F.transform("samples", lambda s: F.concat(s["sample_idx"].cast("string"), F.lit(":"), s["text"]))
    return gen.regroup(rows, "doc_id", ["text"]).select(
        "doc_id", F.size("samples").cast("bigint").alias("n_samples"), F.md5(F.array_join(joined, "|")).alias("joined")
    )


@query(f"select doc_id, {stub_sql('text', '0')} as generated, null::varchar as error from documents")
def generate_text(spark, sf):
    made = gen.generate_text(table(spark, sf, "documents"), F.col("text"), fx.stub_factory)
    return made.select("doc_id", "generated", "error")


@query(f"""select doc_id, case when length(text) % 7 = 0 then '' else {stub_sql('text', '0')} end as generated,
  case when length(text) % 7 = 0 then 'model failed' end as error from documents""")
def generate_with_empty_on_error(spark, sf):
    made = gen.generate_text(
        table(spark, sf, "documents"), F.col("text"), fx.failing_factory, on_error="empty"
    )
    return made.select("doc_id", "generated", "error")


@query(f"""select doc_id, length(text) % 7 <> 0 as kept,
  case when length(text) % 7 <> 0 then {stub_sql('text', '0')} end as generated from documents""")
def generate_with_skip_on_error(spark, sf):
    made = gen.generate_text(
        table(spark, sf, "documents"), F.col("text"), fx.failing_factory, on_error="skip"
    )
    return made.select("doc_id", F.col("error").isNull().alias("kept"), "generated")


@query(f"""with prompts as (select doc_id, concat({quoted(_BEFORE)}, text, {quoted(_AFTER)}) as p from documents)
select d.doc_id, {strip_sql("concat(text, ' [', md5(p), ']')")} as generated from prompts join documents d on d.doc_id = prompts.doc_id""")
def prompt_and_generate(spark, sf):
    made = gen.prompt_and_generate(table(spark, sf, "documents"), F.col("text"), fx.echo_factory)
    return made.select("doc_id", "generated")


# picks the sample at the density mode from sc(doc_id, label, text, i, gen, score)
CHOOSE_SQL = """
st as (select doc_id, count(*) as n, stddev_pop(score) as sd, min(score) as mn, max(score) as mx from sc group by doc_id),
h0 as (select *, case when sd > 1e-6 then pow(4 * pow(sd, 5) / (3 * n), 0.2) else 0.1 end as b from st),
h as (select *, case when b < 1e-6 then 0.1 else b end as bw from h0),
gr as (select h.*, k, mn - 0.5 * sd + k * ((mx + 0.5 * sd) - (mn - 0.5 * sd)) / 499 as x from h cross join range(500) u(k)),
de as (select gr.doc_id, k, x, sum(exp(-0.5 * pow((x - sc.score) / bw, 2))) as dn from gr join sc on sc.doc_id = gr.doc_id group by gr.doc_id, k, x),
pk as (select doc_id, x from (select *, row_number() over (partition by doc_id order by dn desc, k) as r from de) where r = 1),
se as (select sc.*, row_number() over (partition by sc.doc_id order by abs(score - x), i) as r from sc join pk on pk.doc_id = sc.doc_id)
select doc_id, label, i::integer as sample_idx, concat(text, ' ', gen) as text from se where r = 1"""


@query(f"""with {FX_LABELED},
f as (select l.doc_id, l.label, l.text, i, {stub_sql("substring(l.text, 1, 500)", "i")} as raw from fx_labeled l cross join range(5) r(i)),
g as (select *, {first_sentence_sql("raw")} as gen from f),
sc as (select g.*, round(list_sum(e.embedding::double[]), 6) as score
       from g join embeddings e on e.vec_id = (g.doc_id * 5 + g.i) % (select count(*) from embeddings)),
{CHOOSE_SQL}""")
def augment_best_of_n(spark, sf):
    inputs = fx_labeled(spark, sf).select("doc_id", "text", "label")
    scores = fx.fx_scores(spark, sf)
    chosen = augment.augment_with_scores(
        inputs, fx.stub_factory, scores, "doc_id", prompt=fx.whole_prompt
    )
    return chosen.select("doc_id", "label", "sample_idx", "text")


# rendered default chat around the input
_CHAT_BEFORE = "system\n" + SYSTEM_ENGLISH + "".join(f"user\n{a}assistant\n{b}" for a, b in EXAMPLES) + "user\n"
_CHAT_SQL = f"concat({quoted(_CHAT_BEFORE)}, substring(l.text, 1, 500), 'assistant' || chr(10))"


@query(f"""with {FX_LABELED},
f as (select l.doc_id, l.label, l.text, i, {fx.varied_sql(_CHAT_SQL, "i")} as gen from fx_labeled l cross join range(5) r(i)),
sc as (select *, length(gen)::double as score from f),
{CHOOSE_SQL}""")
def augment_with_default_prompt(spark, sf):
    """The whole step with the default chat as prompt and a score column that differs from sample to sample."""
    inputs = fx_labeled(spark, sf).select("doc_id", "text", "label")
    chosen = augment.augment_best_of_n(inputs, fx.varied_factory, lambda _, s: F.length(s).cast("double"))
    return chosen.select("doc_id", "label", "sample_idx", "text")


@query(f"""with {FX_LABELED}
select doc_id, i::integer as sample_idx, 'model failed' as error, true as all_failed
from fx_labeled cross join range(5) r(i) where length(substring(text, 1, 500)) % 7 = 0""")
def augment_rejects(spark, sf):
    """What a failing model leaves behind: each failed sample with its error."""
    inputs = fx_labeled(spark, sf).select("doc_id", "text", "label")
    _, rejects = augment.augment_with_rejects(
        inputs,
        scratch_path(spark, "augmented-samples"),
        "doc_id",
        fx.failing_factory,
        lambda _, s: F.length(s).cast("double"),
        prompt=fx.whole_prompt,
    )
    return rejects


# length of the rendered conversation without the input and the reply
_FRAME_CHARS = len("system\n" + SYSTEM_ENGLISH) + len("user\nassistant\n")
_FRAME_CHARS += sum(len(f"user\n{given}assistant\n{wanted}") for given, wanted in EXAMPLES)


@query(f"""with {FX_LABELED},
f as (select l.doc_id, l.label, l.text, i, {fx.varied_sql("substring(l.text, 1, 500)", "i")} as raw from fx_labeled l cross join range(5) r(i)),
g as (select *, {first_sentence_sql("raw")} as gen from f),
sc as (select *, ({_FRAME_CHARS} + length(substring(text, 1, 500)) + length(gen))::double as score from g),
{CHOOSE_SQL}""")
def augment_with_scorer(spark, sf):
    """Array layout with a second model call that scores each conversation."""
    inputs = fx_labeled(spark, sf).select("doc_id", "text", "label")
    chosen = augment.augment_with_scorer(inputs, fx.varied_factory, fx.length_scorer, prompt=fx.whole_prompt)
    return chosen.select("doc_id", "label", "sample_idx", "text")


@query(f"""with {FX_LABELED},
f as (select doc_id, text, i, {stub_sql("substring(text, 1, 500)", "i")} as raw from fx_labeled cross join range(5) r(i)),
g as (select doc_id, text, i, {first_sentence_sql("raw")} as gen from f),
c as (select *, (length(gen) * 10 + i * i * i)::double as score, row_number() over (partition by doc_id order by length(gen) * 10 + i * i * i, i) as r from g)
select doc_id, concat_ws('|', list_extract(list(gen order by r), 1), list_extract(list(gen order by r), 5)) as ends,
  round(sum(score), 6) as total from c group by doc_id""")
def ranked_rewrites(spark, sf):
    """Array layout: generation, scoring by a column and ranking without a shuffle."""
    made = augment.with_samples(
        fx_labeled(spark, sf).select("doc_id", "text"), fx.stub_factory, prompt=fx.whole_prompt
    )
    i = lambda s: s["sample_idx"]
    scored = F.transform(
        "samples",
        lambda s: F.struct(
            i(s).alias("sample_idx"), s["text"].alias("text"), (F.length(s["text"]) * 10 + i(s) * i(s) * i(s)).cast("double").alias("score")
        ),
    )
    ranked = made.select("doc_id", sel.ranked_samples(scored).alias("samples"))
    total = F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + s["score"])
    return ranked.select(
        "doc_id",
        F.concat_ws("|", F.col("samples")[0]["text"], F.col("samples")[4]["text"]).alias("ends"),
        F.round(total, 6).alias("total"),
    )


# -- uncertainty --------------------------------------------------------------------------------


def _whole(vec: str):
    """Length and sum of a vector."""
    return [F.size(vec).cast("bigint").alias("n"), F.round(fx.total(F.col(vec)), 6).alias("total")]


@query("""
select vec_id // 5 as sample_id, vec_id % 5 as pos, len(embedding)::bigint as n, round(list_sum(embedding::double[]), 6) as total
from embeddings where vec_id % 5 >= 1 and vec_id % 5 < 4""")
def span_tokens(spark, sf):
    tokens = tokens_of(spark, sf, 5, "logits")
    kept = un.span_tokens(tokens, fx.fx_spans(tokens, 1, 4))
    return kept.select("sample_id", "pos", *_whole("logits"))


@query("""select vec_id, label as layer, len(embedding)::bigint as n, round(list_sum(embedding::double[]), 6) as total
from embeddings where label = 5""")
def middle_layer(spark, sf):
    hidden = fx.vectors(spark, sf).withColumnRenamed("label", "layer")
    rows = un.middle_layer(hidden, num_layers=10)
    return rows.select("vec_id", "layer", *_whole("vec"))


def _entropy_sql(condition: str, top: str, normalize: str) -> str:
    return f"""
with l as (select vec_id, unnest(embedding)::double as x from embeddings where {condition}),
r as (select *, row_number() over (partition by vec_id order by x desc) as r from l),
t as (select vec_id, x - max(x) over (partition by vec_id) as d from r where {top}),
p as (select vec_id, exp(d) / sum(exp(d)) over (partition by vec_id) as p from t)
select vec_id // 5 as sample_id, round({normalize}, 6) as logit_entropy from p group by 1"""


def _entropy(spark, sf, start, end, **settings):
    tokens = tokens_of(spark, sf, 5, "logits")
    scores = un.logit_entropy(tokens, fx.fx_spans(tokens, start, end), **settings)
    return scores.select("sample_id", F.round("logit_entropy", 6).alias("logit_entropy"))


@query(_entropy_sql("vec_id % 5 >= 1", "r <= 10", "avg(-p * ln(p))"))
def logit_entropy_top_k(spark, sf):
    return _entropy(spark, sf, 1, 5, top_k=10, wide=False)


@query(_entropy_sql("true", "true", "avg(-p * ln(p))"))
def logit_entropy_all(spark, sf):
    return _entropy(spark, sf, 0, 5)


@query(_entropy_sql("vec_id % 5 < 3", "r <= 50", "avg(-p * ln(p))"))
def logit_entropy_wide(spark, sf):
    return _entropy(spark, sf, 0, 3, top_k=50, wide=True)


@query(_entropy_sql("true", "true", "sum(-p * ln(p)) / count(distinct vec_id)"))
def logit_entropy_summed(spark, sf):
    return _entropy(spark, sf, 0, 5, normalize="sum")


def svd_sql(size: int) -> str:
    """Closed form of the 3 x 3 determinant for the last three of ``size`` tokens."""
    return f"""v as (select vec_id, generate_subscripts(embedding, 1) as j, unnest(embedding)::double as x from embeddings where vec_id % {size} >= {size - 3}),
z as (select vec_id // {size} as sample_id, vec_id % {size} - {size - 3} as pos, j, x - avg(x) over (partition by vec_id) as z from v),
w as (select sample_id, j, sum(z) filter (where pos = 0) as a, sum(z) filter (where pos = 1) as b, sum(z) filter (where pos = 2) as c
      from z group by 1, 2),
g as (select sample_id, sum(a*a) + 0.001 as aa, sum(b*b) + 0.001 as bb, sum(c*c) + 0.001 as cc, sum(a*b) as ab, sum(a*c) as ac, sum(b*c) as bc
      from w group by 1),
svd as (select sample_id, ln(aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac)) / 3 as svd_score from g)"""


@query(f"with {svd_sql(4)} select sample_id, round(svd_score, 6) as svd_score from svd")
def svd_score(spark, sf):
    hidden = tokens_of(spark, sf, 4, "vec").withColumn("layer", F.lit(0))
    scores = un.svd_score(hidden, fx.fx_spans(hidden, 1, 4), layer=0)
    return scores.select("sample_id", F.round("svd_score", 6).alias("svd_score"))


@query(f"with {svd_sql(4)} select sample_id, round(svd_score, 6) as svd_score from svd")
def svd_score_by_tiles(spark, sf):
    """The same through tiles of the d x d matrices, as for long samples of wide vectors."""
    hidden = tokens_of(spark, sf, 4, "vec").withColumn("layer", F.lit(0))
    scores = un.svd_score(hidden, fx.fx_spans(hidden, 1, 4), layer=0, max_tokens=2, max_width=32, tile=32)
    return scores.select("sample_id", F.round("svd_score", 6).alias("svd_score"))


@query(f"""with {FX_ATTENTION},
heads as (select sample_id, head, avg(ln(own)) as m from fx_attention where pos >= 1 group by 1, 2)
select sample_id, round(sum(m), 6) as attn_eig from heads group by 1""")
def attention_score(spark, sf):
    attention = fx.fx_attention(spark, sf)
    scores = un.attention_score(attention, fx.fx_spans(attention, 1, 4), layer=0)
    return scores.select("sample_id", F.round("attn_eig", 6).alias("attn_eig"))


@query(f"""with {FX_ATTENTION}
select sample_id, pos, round(ln(own + 1e-12), 6) as log_diagonal from fx_attention where head = 1 and pos >= 0 and pos < 3""")
def attention_diagonal(spark, sf):
    rows = un.attention_diagonal(fx.fx_attention(spark, sf), layer=0, head=1, start=0, end=3)
    return rows.select("sample_id", "pos", F.round("log_diagonal", 6).alias("log_diagonal"))


# hidden states of the middle three of five tokens per sample, attention for some of the samples only
_METRICS_SQL = f"""{svd_sql(4)}, {FX_ATTENTION},
heads as (select sample_id, head, avg(ln(own)) as m from fx_attention where pos >= 1 group by 1, 2),
attn as (select sample_id, sum(m) as attn_eig from heads group by 1),
l as (select vec_id, unnest(embedding)::double as x from embeddings where vec_id % 4 >= 1),
r as (select *, row_number() over (partition by vec_id order by x desc) as r from l),
t as (select vec_id, x - max(x) over (partition by vec_id) as d from r where r <= 50),
p as (select vec_id, exp(d) / sum(exp(d)) over (partition by vec_id) as p from t),
ent as (select vec_id // 4 as sample_id, avg(-p * ln(p)) as logit_entropy from p group by 1),
metrics as (
  select ent.sample_id, svd.svd_score, coalesce(attn.attn_eig, 0.0) as attn_eig, ent.logit_entropy
  from ent left join svd on svd.sample_id = ent.sample_id left join attn on attn.sample_id = ent.sample_id)"""


def _metrics(spark, sf):
    logits = tokens_of(spark, sf, 4, "logits")
    hidden = tokens_of(spark, sf, 4, "vec").withColumn("layer", F.lit(0))
    spans = fx.fx_spans(logits, 1, 4)
    return un.calculate_metrics(spans, logits, hidden, fx.fx_attention(spark, sf), layer=0, top_k=50)


@query(f"""with {_METRICS_SQL} select sample_id, round(svd_score, 6) as svd_score, round(attn_eig, 6) as attn_eig,
  round(logit_entropy, 6) as logit_entropy from metrics""")
def calculate_metrics(spark, sf):
    names = ("svd_score", "attn_eig", "logit_entropy")
    return _metrics(spark, sf).select("sample_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"""with {_METRICS_SQL} select sample_id, round(svd_score, 6) as svd_score, round(attn_eig, 6) as attn_eig,
  round(logit_entropy, 6) as logit_entropy from metrics""")
def metrics_from_arrays(spark, sf):
    """The same scores with one row per sample, scored without a shuffle once the fixture is grouped."""
    tokens = tokens_of(spark, sf, 4, "vec").withColumnRenamed("pos", "sample_idx")
    rows = gen.into_slots(tokens, "sample_id", F.col("vec"), 4, "vectors")
    own = fx.fx_attention(spark, sf).withColumn("own", F.col("row")[F.col("pos")])
    heads = own.withColumn("sample_idx", F.col("head") * 4 + F.col("pos"))
    flat = gen.into_slots(heads, "sample_id", F.col("own"), 8, "flat")
    both = F.array(F.slice("flat", 1, 4), F.slice("flat", 5, 4))
    by_head = flat.select("sample_id", F.filter(both, lambda h: F.exists(h, lambda x: x.isNotNull())).alias("own"))
    samples = rows.join(by_head, "sample_id", "left").withColumns(
        {"logits": F.col("vectors"), "start": F.lit(1), "end": F.lit(4)}
    )
    names = ("svd_score", "attn_eig", "logit_entropy")
    return un.metrics_from_arrays(samples, top_k=50).select("sample_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"""with {_METRICS_SQL}
select l.doc_id, m.sample_id is null as failed, round(m.svd_score, 6) as finite_svd, round(coalesce(m.attn_eig, 0.0), 6) as attn_eig,
  round(coalesce(m.logit_entropy, 0.0), 6) as logit_entropy
from labels l left join metrics m on m.sample_id = l.doc_id""")
def failed_score_sentinels(spark, sf):
    """Scores attached to documents; those beyond the scored samples get the sentinels."""
    scores = _metrics(spark, sf).withColumnRenamed("sample_id", "doc_id")
    out = un.attach_scores(table(spark, sf, "labels").select("doc_id"), scores, ["doc_id"])
    failed = F.col("svd_score") == float("inf")
    return out.select(
        "doc_id",
        failed.alias("failed"),
        F.when(~failed, F.round("svd_score", 6)).alias("finite_svd"),
        F.round("attn_eig", 6).alias("attn_eig"),
        F.round("logit_entropy", 6).alias("logit_entropy"),
    )


@query(f"""with {_METRICS_SQL}, {FX_LABELED},
fx_candidates as (
  select l.doc_id as input_key, i as sample_idx, {stub_sql("l.text", "i")} as text,
         case when m.svd_score is null then 'inf'::double else round(m.svd_score, 6) end as score
  from fx_labeled l cross join range(5) r(i) left join metrics m on m.sample_id = l.doc_id * 5 + i),
{BEST_SQL}
select l.doc_id, l.label, b.sample_idx::integer as sample_idx, concat(l.text, ' ', b.text) as text
from best b join fx_labeled l on l.doc_id = b.input_key""")
def augment_from_model_outputs(spark, sf):
    """From the tables that a model leaves to the augmented text: metrics, scores of the samples, choice.

    Samples beyond the scored ones have failed; an input with failed samples only keeps its first one.
    """
    inputs = fx_labeled(spark, sf).select("doc_id", "text", "label")
    numbers = F.sequence(F.lit(0), F.lit(fx.SAMPLES - 1))
    texts = F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("sample_idx"),
            F.concat(F.lit("aug "), F.md5("text"), F.lit(": "), F.col("text"), F.lit(" #"), i.cast("string")).alias("text"),
            F.lit(None).cast("string").alias("error"),
        ),
    )
    metrics = _metrics(spark, sf).withColumn("svd_score", F.round("svd_score", 6))
    chosen = augment.augment_from_metrics(inputs.withColumn("samples", texts), metrics, "doc_id", fx.SAMPLES)
    return chosen.select("doc_id", "label", "sample_idx", "text")


# -- choice -------------------------------------------------------------------------------------


@query(f"""with {FX_CANDIDATES}
select input_key, sample_idx, row_number() over (partition by input_key order by score, sample_idx) as rank from fx_candidates""")
def rank_candidates(spark, sf):
    return sel.rank_candidates(fx_candidates(spark, sf), "input_key").select("input_key", "sample_idx", "rank")


@query(f"""with {FX_CANDIDATES}
select input_key, sample_idx, text from (
  select *, row_number() over (partition by input_key order by score, sample_idx) as rank from fx_candidates) where rank = 1""")
def lowest_candidates(spark, sf):
    return sel.lowest_candidates(fx_candidates(spark, sf), "input_key").select("input_key", "sample_idx", "text")


@query(f"""with {FX_CANDIDATES}
select input_key, count(*) filter (where score < 'inf'::double) as n_valid, count(*) filter (where score < 'inf'::double) > 1 as has_mode
from fx_candidates group by 1""")
def valid_scores(spark, sf):
    n = F.count_if(is_valid_score(F.col("score")))
    return fx_candidates(spark, sf).groupBy("input_key").agg(n.alias("n_valid"), (n > 1).alias("has_mode"))


@query(f"with {FX_CANDIDATES} select input_key, round(sd, 6) as sd, round(bandwidth, 6) as bandwidth from widths")
def score_bandwidths(spark, sf):
    moments = sel.score_moments(fx_candidates(spark, sf), "input_key").where(F.col("n_valid") > 0)
    return moments.select("input_key", F.round("sd", 6).alias("sd"), F.round("bandwidth", 6).alias("bandwidth"))


@query(f"with {FX_CANDIDATES} select input_key, round(mode, 6) as mode from modes")
def density_modes(spark, sf):
    return sel.density_modes(fx_candidates(spark, sf), "input_key").select("input_key", F.round("mode", 6).alias("mode"))


@query(f"""with {FX_CANDIDATES} select input_key, sample_idx, text from best""")
def best_candidates(spark, sf):
    best = sel.best_candidates(fx_candidates(spark, sf), "input_key", payload=["text"])
    return best.select("input_key", "sample_idx", "text")


@query(f"""with {FX_CANDIDATES},
ranked as (select input_key, string_agg(text, '|' order by score, sample_idx) as ranked from fx_candidates group by 1)
select 'input ' || r.input_key as input_text, ranked, b.text as best_sample from ranked r join best b on b.input_key = r.input_key""")
def input_results(spark, sf):
    grouped = gen.regroup(fx_candidates(spark, sf), "input_key", ["text", "score"])
    named = grouped.withColumn("text", F.concat(F.lit("input "), F.col("input_key").cast("string")))
    results = sel.input_results(named, "text")
    return results.select(
        "input_text", F.array_join(F.transform("samples", lambda s: s["text"]), "|").alias("ranked"), "best_sample"
    )
