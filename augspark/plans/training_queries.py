"""Training runs: learned weights of label words, the ratings of their epochs, and a trained few-shot run."""

from __future__ import annotations

from pyspark.sql import functions as F

from augspark.operators import lexicon as lx
from augspark.plans import classify, training
from augspark.plans.evaluation_queries import EVALUATION_COLUMNS
from augspark.plans.file_queries import _CALIBRATED_LOGS_SQL, _few_shot_files, _few_shot_record, _few_shot_sql, _word_logit
from augspark.plans.fixtures import FX_LEXICON, FX_WORD_SCORES, fx_lexicon, vectors
from augspark.plans.registry import query
from augspark.session import scratch_path


def _epochs_sql(epochs: int, rate: float, first: str) -> str:
    """Full-batch epochs over ``logs`` (example, label, held, word, class_id, l): tables state<t>, loss<t>, scores<t>.

    state0 has the weights before training; scores<t> are the class scores with the weights of state<t>.
    """
    out = f"""
state0 as (select word, class_id, ({first})::double as w, 0.0::double as m, 0.0::double as v from lexicon),
share0 as (select *, exp(w) / sum(exp(w)) over (partition by class_id) as a from state0),
scores0 as materialized (select example, label, held, class_id, sum(a * l) as s from logs join share0 using (word, class_id) group by all)"""
    for t in range(1, epochs + 1):
        size = rate * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        out += f""",
off{t} as (select example, label, class_id, s, exp(s) / sum(exp(s)) over (partition by example) as q from scores{t - 1} where not held),
loss{t} as (select avg(-ln(q)) as loss, count(*) as n from off{t} where class_id = label),
mean{t} as (select word, class_id, avg((q - (class_id = o.label)::int) * a * (l - s)) as g
  from logs join off{t} o using (example, class_id) join share{t - 1} using (word, class_id) group by all),
cut{t} as (select word, class_id, g / greatest(1.0, sqrt(sum(g * g) over ())) as g from mean{t}),
step{t} as (select word, class_id, w, 0.9 * m + (1 - 0.9) * g as m, 0.999 * v + (1 - 0.999) * g * g as v from state{t - 1} join cut{t} using (word, class_id)),
state{t} as materialized (select word, class_id, w - {size!r} * m / (sqrt(v) + 1e-6) as w, m, v from step{t}),
share{t} as (select *, exp(w) / sum(exp(w)) over (partition by class_id) as a from state{t}),
scores{t} as materialized (select example, label, held, class_id, sum(a * l) as s from logs join share{t} using (word, class_id) group by all)"""
    return out


def _best_sql(table: str, keys: str) -> str:
    return f"select {keys}, label, arg_max(class_id, struct_pack(s := round(s, 12), c := -class_id)) as pred from {table} group by all"


_EPOCHS = 3
_LEARNED_SQL = f"""with {FX_WORD_SCORES}, {FX_LEXICON}, lexicon as (select word, class_id, weight from fx_lexicon),
p as (select example, word, class_id, exp(logit) / sum(exp(logit)) over (partition by example) as p from fx_word_scores join lexicon using (word)),
logs as materialized (select example, e.label, example % 4 = 0 as held, word, class_id, ln(p + 1e-15) as l from p join embeddings e on e.vec_id = example),
{_epochs_sql(_EPOCHS, 0.06, "weight")}"""


def _learned(spark, sf) -> str:
    """A stored run over all vectors as model outputs: a quarter of them rate the epochs, the others are learned from."""
    path = scratch_path(spark, "word-weights")
    rows = vectors(spark, sf).select(F.col("vec_id").alias("example"), "label", F.col("vec").alias("logits"))
    held = F.col("example") % 4 == 0
    lexicon = lx.collect_lexicon(fx_lexicon(spark))
    training.train_words(rows.where(~held), rows.where(held), lexicon, path, epochs=_EPOCHS, batch_size=None)
    return path


@query(f"{_LEARNED_SQL} select word, class_id, round(w, 6) as weight from state{_EPOCHS}")
def learned_word_weights(spark, sf):
    weights = training.word_weights(spark, _learned(spark, sf), _EPOCHS - 1)
    return weights.select(F.col("word").cast("bigint"), F.col("class_id").cast("bigint"), F.round("weight", 6).alias("weight"))


_RATED_SQL = " union all ".join(
    f"(with p as ({_best_sql(f'scores{t}', 'example')}) select {t - 1} as epoch, (select loss from loss{t}) as loss, (select n from loss{t}) as n, "
    f"{EVALUATION_COLUMNS} from p join (select distinct example from logs where held) using (example))"
    for t in range(1, _EPOCHS + 1)
)


@query(f"""{_LEARNED_SQL}, rated as ({_RATED_SQL})
select epoch, round(loss, 6) as loss, n, round(accuracy, 6) as val_acc, round(rmse, 6) as rmse, round(mae, 6) as mae from rated""")
def training_epochs(spark, sf):
    epochs = training.epoch_table(spark, _learned(spark, sf))
    return epochs.select("epoch", "n", *[F.round(c, 6).alias(c) for c in ("loss", "val_acc", "rmse", "mae")])


_TRAINED_EPOCHS = 2
# train and validation rows by label in seeded order; the later of equally good epochs counts
_TRAINED_SQL = f""",
shots as (select *, row_number() over (partition by label order by md5('144:' || example), example) as r from each),
wanted as (select example, label, prompt, r > 10 as held from shots where r <= 20),
{_CALIBRATED_LOGS_SQL.format(table="wanted", keys="example, label, held")},
{_epochs_sql(_TRAINED_EPOCHS, 0.06, "0.0")},
rated as ({" union all ".join(f"(with p as ({_best_sql(f'scores{t}', 'example, held')}) select {t} as t, avg((pred = label)::int) as acc from p where held)" for t in range(1, _TRAINED_EPOCHS + 1))}),
chosen as (select max(t) as t from rated where acc = (select max(acc) from rated)),
share as ({" union all ".join(f"select word, class_id, a from share{t}, chosen where t = {t}" for t in range(1, _TRAINED_EPOCHS + 1))}),
{_CALIBRATED_LOGS_SQL.format(table="test", keys="text, label").replace("logs", "test_logs").replace("raw", "test_raw")},
test_scores as (select text, label, class_id, sum(a * l) as s from test_logs join share using (word, class_id) group by all)"""


@query(_few_shot_sql(_TRAINED_SQL, _best_sql("test_scores", "text")))
def few_shot_trained_run(spark, sf):
    """A calibrated run that learns the words' weights on the sampled train rows and chooses the epoch on the validation rows."""
    root = _few_shot_files(spark, sf)
    record = classify.few_shot_run(spark, root, root, "ToxiGen", _word_logit, epochs=_TRAINED_EPOCHS, batch_size=None)
    return _few_shot_record(record)
