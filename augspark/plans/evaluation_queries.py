"""Queries over sampling, evaluation, row identity and resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from augspark.operators import fewshot as fs, incremental as inc
from augspark.plans import augment, classify, fixtures as fx
from augspark.plans.fixtures import FX_LABELED, SEED, fx_labeled, strip_sql, table
from augspark.plans.registry import query
from augspark.plans.sample_queries import CHOOSE_SQL
from augspark.session import scratch_path
from augspark.sources import sinks
from augspark.sources.ledger import read_rejects, read_rows
from augspark.streaming.augment import augment_files, augment_files_once

# -- sampling -----------------------------------------------------------------------------------


@query(f"""
select doc_id, toxic as label, case when r <= 10 then 'train' else 'validation' end as split from (
  select *, row_number() over (partition by toxic order by md5(concat('{SEED}:', doc_id)), doc_id) as r from labels) where r <= 20""")
def few_shot_split(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("toxic", "label")
    return fs.sample_shots(labels, "doc_id", seed=SEED)


@query(f"""
select doc_id, toxic as label, case when r <= 1500 then 'train' else 'validation' end as split from (
  select *, row_number() over (partition by toxic order by md5(concat('{SEED}:', doc_id)), doc_id) as r from labels) where r <= 2000""")
def many_shots(spark, sf):
    """More shots than a task should keep of every label."""
    labels = table(spark, sf, "labels").withColumnRenamed("toxic", "label")
    return fs.sample_shots(labels, "doc_id", shots=1500, dev_shots=500, seed=SEED)


@query(f"select doc_id from labels order by md5(concat('{SEED}:', doc_id)), doc_id limit 200")
def support_sample(spark, sf):
    return fs.sample_total(table(spark, sf, "labels"), "doc_id", seed=SEED)


@query(f"""
select doc_id, r - 1 as position, (r - 1) // 30 as batch_id from (
  select doc_id, row_number() over (order by md5(concat('{SEED}:', doc_id)), doc_id) as r from documents)""")
def shuffled_batches(spark, sf):
    return fs.shuffled_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=SEED)


TEMPLATE = ' {"placeholder": "text_a"} {"special": "<sep>"} The subject here is {"mask"} .'


@query(f"""with {FX_LABELED},
picked as (select *, row_number() over (partition by label order by md5(concat('{SEED}:', doc_id)), doc_id) as r from fx_labeled),
rows as (
  select doc_id, label, case when r <= 10 then 'train' else 'validation' end as split, text from picked where r <= 20
  union all select doc_id, label, 'test', text from fx_labeled),
words as (select *, string_split_regex({strip_sql("text")}, '[ \\t\\n\\x0B\\f\\r]+') as w from rows)
select doc_id, label, split, concat(' ', array_to_string(w[1:128], ' '), ' <sep> The subject here is [MASK] .') as prompt from words""")
def few_shot_prompts(spark, sf):
    labeled = fx_labeled(spark, sf)
    return classify.few_shot_prompts(labeled, labeled, TEMPLATE, "doc_id", seed=SEED)


# -- evaluation ---------------------------------------------------------------------------------


def fx_preds(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("label"), (1 - F.col("quality")).alias("pred")
    )


EVALUATION_COLUMNS = """
avg((label = pred)::integer) as accuracy, sqrt(avg(pow(pred - label, 2))) as rmse, avg(abs(pred - label)) as mae,
coalesce(sum((label = 1 and pred = 1)::integer) / nullif(sum((pred = 1)::integer), 0), 0) as precision,
coalesce(sum((label = 1 and pred = 1)::integer) / nullif(sum((label = 1)::integer), 0), 0) as recall"""


@query("""select round(avg((toxic = 1 - quality)::integer), 6) as accuracy, round(sqrt(avg(pow(1 - quality - toxic, 2))), 6) as rmse,
  round(avg(abs(1 - quality - toxic)), 6) as mae from labels""")
def accuracy_and_errors(spark, sf):
    names = ("accuracy", "rmse", "mae")
    return fs.evaluate(fx_preds(spark, sf)).select(*[F.round(n, 6).alias(n) for n in names])


@query(f"""with p as (select lang, toxic as label, 1 - quality as pred from documents join labels using (doc_id)),
e as (select lang, {EVALUATION_COLUMNS} from p group by 1)
select lang, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from e""")
def precision_recall_f1(spark, sf):
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    scores = fs.evaluate(fx_preds(spark, sf).join(langs, "doc_id"), by=["lang"])
    return scores.select("lang", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")])


@query(f"""with p as (select doc_id % 5 as epoch, toxic as label, 1 - quality as pred from labels),
e as (select epoch, {EVALUATION_COLUMNS} from p group by 1)
select epoch, round(accuracy, 6) as val_acc, round(rmse, 6) as rmse, round(mae, 6) as mae from e order by accuracy desc, epoch desc limit 1""")
def best_epoch(spark, sf):
    preds = fx_preds(spark, sf).withColumn("epoch", F.col("doc_id") % 5)
    epochs = fs.evaluate(preds, by=["epoch"]).select("epoch", F.col("accuracy").alias("val_acc"), "rmse", "mae")
    return fs.best_epoch(epochs).select("epoch", *[F.round(n, 6).alias(n) for n in ("val_acc", "rmse", "mae")])


@query("""
with shots as (select toxic, least(count(*), 10) as train, greatest(least(count(*), 20) - 10, 0) as validation from labels group by 1),
facts as (select 'train' as split, sum(train) as n, sum(train * toxic) as positives from shots
  union all select 'validation', sum(validation), sum(validation * toxic) from shots
  union all select 'test', count(*), sum(toxic) from labels)
select split, n::bigint as n, positives::bigint as positives, true as disjoint, split <> 'train' as rated, true as in_bounds,
  case when split <> 'train' then 1.0::double end as marked_accuracy from facts""")
def train_and_test_classifier(spark, sf):
    """Fit on the few-shot train rows, rate the validation rows and all labelled rows: what is fixed of that.

    The rows of each split and their labels, that no row is in two of the few-shot splits, that every metric
    lies within its bounds, and that a classifier of texts which begin with a word of their label is always right.
    """
    labeled = fx_labeled(spark, sf).select("doc_id", "text", "label")
    split = fs.sample_shots(labeled, "doc_id", seed=SEED).select("doc_id", "split")
    shots = labeled.join(split, "doc_id")
    model = fs.fit_classifier(shots.where(F.col("split") == "train"))
    validation = fs.classify(model, shots.where(F.col("split") == "validation").drop("split"))
    tested = fs.classify(model, labeled)
    both = validation.select(F.lit("validation").alias("split"), "label", "pred").unionByName(
        tested.select(F.lit("test").alias("split"), "label", "pred")
    )
    rated = fs.evaluate(both, by=["split"])
    marker = F.concat(F.when(F.col("label") == 1, "yes ").otherwise("no "), (F.col("doc_id") % 7).cast("string"))
    easy = labeled.withColumn("text", marker)
    taught = fs.fit_classifier(easy.join(split.where("split = 'train'"), "doc_id"))
    told = fs.classify(taught, easy.select(F.lit("test").alias("split"), "label", "text").unionByName(
        easy.join(split.where("split = 'validation'"), "doc_id").select("split", "label", "text")))
    marked = fs.evaluate(told, by=["split"]).select("split", F.col("accuracy").alias("marked_accuracy"))
    rates = [F.col(c).between(0, 1) for c in ("accuracy", "rmse", "mae", "precision", "recall", "f1")]
    bounds = rated.select("split", reduce(lambda a, b: a & b, rates).alias("in_bounds"))
    once = split.groupBy("doc_id").count().agg(F.max("count") == 1).scalar()
    rows = shots.select("split", "label").unionByName(labeled.select(F.lit("test").alias("split"), "label"))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))
    return counts.join(bounds, "split", "left").join(marked, "split", "left").select(
        "marked_accuracy", "split", "n", "positives", once.alias("disjoint"), F.col("in_bounds").isNotNull().alias("rated"), F.coalesce("in_bounds", F.lit(True)).alias("in_bounds")
    )


# -- identity and resuming ----------------------------------------------------------------------


@query("select doc_id, row_number() over (order by doc_id) - 1 as guid from documents")
def row_positions(spark, sf):
    return inc.with_position(table(spark, sf, "documents").select("doc_id"), [F.col("doc_id")])


@query("""select doc_id, md5(concat('=', text, chr(31), '=', lang)) as content_key,
  row_number() over (partition by text, lang order by doc_id) as occurrence from documents""")
def content_keys(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return inc.with_content_key(docs, ["text", "lang"], [F.col("doc_id")]).select("doc_id", "content_key", "occurrence")


@query("""select format, count(*) filter (where quality = 1) as written, count(*) filter (where quality = 0) as remaining
from documents join labels using (doc_id) cross join (values ('csv'), ('parquet')) f(format) group by 1""")
def written_progress(spark, sf):
    """Rows in the output so far, for both formats of it."""
    rows = fx_labeled(spark, sf)
    found = []
    for format in ("csv", "parquet"):
        path = scratch_path(spark, "progress")
        sinks.append_rows(rows.where(F.col("quality") == 1), path, format)
        found.append((format, inc.written_rows(spark, path, format)))
    n = F.expr("stack(2, " + ", ".join(f"'{f}', {n}L" for f, n in found) + ") as (format, written)")
    return rows.agg(F.count("*").alias("n")).select("n", n).select("format", "written", (F.col("n") - F.col("written")).alias("remaining"))


@query(f"""with {FX_LABELED},
g as (select doc_id, label, text, i, {fx.varied_sql("substring(text, 1, 500)", "i")} as gen from fx_labeled cross join range(5) r(i)),
sc as (select *, length(gen)::double as score from g),
{CHOOSE_SQL}""")
def resume_csv(spark, sf):
    """CSV output of a job that was started three times, the first time on some rows only."""
    target = scratch_path(spark, "resumed")
    inputs = fx_labeled(spark, sf).select("doc_id", "label", "text")

    def step(rows):
        return augment.augment_best_of_n(rows, fx.varied_factory, _length_score, prompt=fx.whole_prompt)

    for part in (inputs.where("label = 1"), inputs, inputs):
        augment.augment_pending(part, target, ["doc_id"], step, format="csv")
    written = inc.read_written(spark, target, "csv")
    return written.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"), F.col("sample_idx").cast("int"), "text")


@query("select doc_id, text from documents where doc_id not in (select doc_id from labels)")
def unprocessed_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return inc.unprocessed(docs, table(spark, sf, "labels"), ["doc_id"])


def _length_score(text, sample):
    """Stand-in for an uncertainty score."""
    return F.length(sample).cast("double")


@query(f"""with {FX_LABELED},
g as (select doc_id, label, text, i, {fx.varied_sql("substring(text, 1, 500)", "i")} as gen from fx_labeled cross join range(5) r(i)),
sc as (select *, length(gen)::double as score from g),
{CHOOSE_SQL}""")
def stream_augmentation(spark, sf):
    """The files of a folder, augmented by a stream that ends when it has seen them all."""
    source = scratch_path(spark, "stream-in")
    target = scratch_path(spark, "stream-out")
    inputs = fx_labeled(spark, sf).select("doc_id", "label", "text")
    inputs.write.parquet(source)

    def step(files):
        return augment.augment_best_of_n(
            files, fx.varied_factory, _length_score, prompt=fx.whole_prompt
        )

    augment_files(spark, source, inputs.schema, target, scratch_path(spark, "stream-state"), step).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "label", "sample_idx", "text")


def _scored_samples(df, factory, **settings):
    """Rows with samples and scores, before the choice."""
    made = augment.with_samples(df, factory, prompt=fx.whole_prompt, on_error="skip", **settings)
    return made.withColumn("scores", F.transform("samples", lambda s: F.length(s["text"]).cast("double")))


_FAILS_SQL = "length(substring(text, 1, 500)) % 7 = 0"
_RETRIED_SQL = f"""{FX_LABELED},
g as (select doc_id, label, text, i, {fx.stub_sql("substring(text, 1, 500)", "i")} as whole from fx_labeled cross join range(5) r(i)),
f as (select *, {fx.first_sentence_sql("whole")} as gen from g),
sc as (select *, length(gen)::double as score from f)"""


@query(f"""with done as (with {_RETRIED_SQL},
{CHOOSE_SQL}),
{FX_LABELED}
select doc_id, label, sample_idx, text, null::varchar as error from done
  where doc_id not in (select doc_id from fx_labeled where {_FAILS_SQL})
union all select doc_id, label, null, text, 'model failed' from fx_labeled where {_FAILS_SQL}""")
def stream_to_csv(spark, sf):
    """A stream whose model fails on some rows: CSV of the rewritten rows and the rejects beside it, each batch once."""
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-csv")
    inputs = fx_labeled(spark, sf).select("doc_id", "label", "text")
    inputs.repartition(3).write.parquet(source)

    def step(batch):
        return _scored_samples(batch, fx.failing_factory)

    state = scratch_path(spark, "stream-state")
    for _ in range(2):  # a stream that is started again finds nothing to do
        augment_files_once(
            spark, source, inputs.schema, target, state, step, augment.split_augmented(), files_per_batch=1
        ).awaitTermination()
    rows, rejects = read_rows(spark, target), read_rejects(spark, target)
    written = rows.select(
        F.col("doc_id").cast("bigint"), F.col("label").cast("int"), F.col("sample_idx").cast("int"), "text", F.lit(None).cast("string").alias("error")
    )
    return written.unionByName(rejects.select("doc_id", "label", F.lit(None).cast("int").alias("sample_idx"), "text", "error"))


@query(f"with {FX_LABELED} select doc_id, 3 as attempts, 'model failed' as error from fx_labeled where {_FAILS_SQL}")
def given_up_rows(spark, sf):
    """The rows that a model failed on in three rounds, with their last error; all others are written."""
    inputs = fx_labeled(spark, sf).select("doc_id", "label", "text")
    target = scratch_path(spark, "retries")
    given_up = augment.augment_with_retries(
        inputs, target, ["doc_id"], lambda rest: _scored_samples(rest, fx.failing_factory), augment.split_augmented()
    )
    return given_up.select("doc_id", F.col("attempts").cast("int"), "error")
