"""Queries that write derived files to the shared folder and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from augspark.operators.fewshot import evaluate
from augspark.operators.incremental import read_written
from augspark.plans.evaluation_queries import EVALUATION_COLUMNS, fx_preds
from augspark.plans import classify
from augspark.plans.fixtures import FX_LABELED, SEED, fx_labeled, strip_sql, table
from augspark.plans.registry import query
from augspark.plans.text_queries import CLEAN_COMMAS_SQL
from augspark.session import scratch_path
from augspark.sources import catalog, labeled, lexicons, sinks

CLASSES = ["not_cyberbullying", "cyberbullying"]
CLASS_NAME = "case label when 1 then 'cyberbullying' else 'not_cyberbullying' end"


def _class_name():
    return F.when(F.col("label") == 1, "cyberbullying").otherwise("not_cyberbullying")


def _written(spark, df, header=False):
    path = scratch_path(spark, "csv")
    sinks.write_labeled_csv(df, path, header)
    return path


@query(f"with {FX_LABELED} select text, label from fx_labeled")
def read_label_first(spark, sf):
    path = _written(spark, fx_labeled(spark, sf).select("label", "text"))
    return labeled.read_labeled(spark, path)


@query(f"with {FX_LABELED} select text, label from fx_labeled")
def read_label_first_with_header(spark, sf):
    path = _written(spark, fx_labeled(spark, sf).select("label", "text"), header=True)
    return labeled.read_labeled(spark, path, header=True)


@query(f"with {FX_LABELED} select text, 1 - label as label from fx_labeled")
def read_text_first_with_names(spark, sf):
    path = _written(spark, fx_labeled(spark, sf).select("text", _class_name().alias("label")), header=True)
    return labeled.read_labeled(spark, path, "text_label", True, classes=["cyberbullying", "not_cyberbullying"])


@query(f"with {FX_LABELED} select '某人 ' || text as text, label from fx_labeled")
def read_masked_with_byte_order_mark(spark, sf):
    rows = fx_labeled(spark, sf).select("label", F.concat(F.lit("USERNAME "), F.col("text")).alias("text"))
    first_of_file = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    marked = rows.select(F.concat(F.when(first_of_file, "\ufeff").otherwise(""), "label").alias("label"), "text")
    return labeled.read_labeled(spark, _written(spark, marked), mask_users=True)


@query(f"""with {FX_LABELED}
select {CLASS_NAME} as cyberbullying_type, case when length(text) % 5 in (0, 1) then null else text end as tweet_text from fx_labeled""")
def read_missing_values(spark, sf):
    rest = F.length("text") % 5
    text = F.when(rest == 0, "NA").when(rest == 1, "").otherwise(F.col("text"))
    path = _written(spark, fx_labeled(spark, sf).select(_class_name().alias("a"), text.alias("b")))
    return labeled.read_augmentation_input(spark, path)


@query(f"with {FX_LABELED} select replace(replace(text, chr(10), ' '), ',', '，') as text, label from fx_labeled")
def read_cleaned_text_first(spark, sf):
    """One unquoted line per row, its text full of commas; cleaning leaves the last one as separator."""
    line = F.concat(F.regexp_replace("text", "\n", " "), F.lit(","), F.col("label").cast("string"))
    raw, cleaned = scratch_path(spark, "raw"), scratch_path(spark, "cleaned")
    fx_labeled(spark, sf).select(line).write.text(raw)
    sinks.clean_text_file(spark, raw, cleaned)
    return labeled.read_labeled(spark, cleaned, "text_label", multiline=False)


@query(f"""with {FX_LABELED},
splits as (select 'tweets' as dataset, case quality when 1 then 'train' else 'test' end as split, 1 - label as label from fx_labeled
  union all select 'tweets', 'validation', 1 - label from fx_labeled
  union all select 'ToxiGen', case quality when 1 then 'train' else 'test' end, label from fx_labeled)
select dataset, split, label, count(*) as n from splits group by 1, 2, 3""")
def dataset_catalog(spark, sf):
    root = scratch_path(spark, "datasets")
    rows = fx_labeled(spark, sf)
    train, test = rows.where(F.col("quality") == 1), rows.where(F.col("quality") == 0)
    named = ["text", _class_name().alias("label")]
    for split, part in (("train", train), ("test", test), ("validation", rows)):
        sinks.write_labeled_csv(part.select(*named), f"{root}/Cyberbullying/tweets/{split}.csv", header=True)
    for split, part in (("train", train), ("test", test)):
        sinks.write_labeled_csv(part.select("label", "text"), f"{root}/Cyberbullying/ToxiGen/{split}.csv")
    read = [catalog.read_dataset(spark, root, name) for name in ("tweets", "ToxiGen")]
    return read[0].unionByName(read[1]).groupBy("dataset", "split", "label").agg(F.count("*").alias("n"))


# first line of a label-word file, then the second one, and the classes they stand for in label order
_LEXICON_FILES = {
    "tweets": ("cyberbullying", "not_cyberbullying", 0, 1),
    "ToxiGen": ("cyberbullying", "not_cyberbullying", 1, 0),
    "LHd": ("cyberbullying", "not_cyberbullying", 1, 0),
    "weibo": ("暴力", "非暴力", 1, 0),
}


@query(f"""with sources as (select distinct source from documents where source is not null),
files as (select * from (values {", ".join(f"('{d}', '{a}', '{b}', {x}, {y})" for d, (a, b, x, y) in _LEXICON_FILES.items())}) v(dataset, one, two, first_class, second_class))
select dataset, source || ' ' || one as word, first_class as class_id from files cross join sources
union all select dataset, source || ' ' || two, second_class from files cross join sources""")
def catalog_lexicon(spark, sf):
    """Label-word files of all known datasets: the line of a class, and the number that the dataset gives the class."""
    root = scratch_path(spark, "scripts")
    sources = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    found = []
    for name, (one, two, _, _) in _LEXICON_FILES.items():
        lines = [F.array_join(F.array_sort(F.collect_set(F.concat("source", F.lit(f" {c}")))), ",") for c in (one, two)]
        both = sources.agg(F.concat_ws("\n", *lines).alias("value"))
        folder = f"{root}/{name}"
        both.coalesce(1).write.text(f"{folder}/{catalog.find_dataset(name).scripts}/manual_verbalizer.txt")
        words = catalog.dataset_lexicon(spark, folder, name, "manual")
        found.append(words.select(F.lit(name).alias("dataset"), "word", "class_id"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query("""select d.dataset, t.template_id, 'line ' || t.template_id || ' of ' || d.dataset || ' with ' || s.n || ' sources {"mask"}' as template
from (values ('tweets'), ('ToxiGen'), ('LHd'), ('weibo')) d(dataset) cross join (select unnest([0, 1, 2]) as template_id) t
cross join (select count(distinct source) as n from documents) s""")
def catalog_template(spark, sf):
    """Template files of all known datasets, read line by line."""
    root = scratch_path(spark, "templates")
    found = []
    for name in _LEXICON_FILES:
        count = table(spark, sf, "documents").agg(F.count_distinct("source").cast("string").alias("n"))
        lines = [F.concat(F.lit(f"line {i} of {name} with "), F.col("n"), F.lit(' sources {"mask"}')) for i in range(3)]
        folder = f"{root}/{name}"
        count.select(F.concat_ws("\n", *lines).alias("value")).coalesce(1).write.text(f"{folder}/{catalog.find_dataset(name).scripts}/manual_template.txt")
        texts = [catalog.dataset_template(spark, folder, name, "manual", i) for i in range(3)]
        rows = [F.struct(F.lit(name).alias("dataset"), F.lit(i).alias("template_id"), F.lit(t).alias("template")) for i, t in enumerate(texts)]
        found.append(count.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query(r"""
with lines as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no,
                      regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g') as line from documents),
marked as (select *, lag(line, 1, '') over (partition by doc_id order by line_no) = '' as opens from lines),
sets as (select *, sum(opens::integer) over (partition by doc_id order by line_no) as s from marked where line <> ''),
numbered as (select *, dense_rank() over (partition by doc_id order by s) - 1 as choice,
                    row_number() over (partition by doc_id, s order by line_no) - 1 as class_id from sets),
words as (select doc_id, choice, class_id, generate_subscripts(string_split(line, ','), 1) - 1 as word_pos, unnest(string_split(line, ',')) as word from numbered)
select doc_id, choice::integer as choice, class_id::integer as class_id, word_pos::integer as word_pos, word from words""")
def lexicon_words(spark, sf):
    """Each document read as a lexicon file: a class per line, its words between commas."""
    return lexicons.parse_lexicon(table(spark, sf, "documents"), "doc_id", "text")


@query("""
select doc_id, c::integer as choice, class_name, (w - 1)::integer as word_pos, case w when 1 then class_word else text end as word
from (select doc_id, 0 as c, lang as class_name, source as class_word, text from documents
      union all select doc_id, 1, source, lang, text from documents) cross join range(1, 3) r(w)""")
def label_word_sets(spark, sf):
    """A JSON array of two class -> words objects per document, written to files and parsed back."""
    one = F.create_map("lang", F.array("source", "text"))
    two = F.create_map("source", F.array("lang", "text"))
    path = scratch_path(spark, "word-sets")
    docs = table(spark, sf, "documents")
    docs.select("doc_id", F.to_json(F.array(one, two)).alias("content")).write.parquet(path)
    return lexicons.parse_word_sets(spark.read.parquet(path), "doc_id")


_FEW_SHOT_TEMPLATE = '{"placeholder": "text_a"} It was {"mask"} .'


def _few_shot_sql(extra: str, predictions: str) -> str:
    """The tables that a run is made of: prompts of all rows, distinct test rows, copies of train rows, and word scores."""
    return f"""with {FX_LABELED},
cut as (select *, array_to_string(string_split_regex({strip_sql("text")}, '[ \\t\\n\\x0B\\f\\r]+')[1:128], ' ') || ' It was [MASK] .' as prompt
        from (select text, label, quality from fx_labeled)),
test as (select distinct text, label, prompt from cut where quality = 0),
each as (select label, prompt, md5('=' || text || chr(31) || '=' || label) || ':' || row_number() over (partition by text, label) as example
  from cut where quality = 1),
lexicon as (select * from (values ('abuse', 1), ('insult', 1), ('calm', 0), ('kind', 0)) w(word, class_id)),
support as (select prompt from each order by md5('144:' || example), example limit 200),
means as (select word, avg({_WORD_SCORE_SQL}) as m from support cross join lexicon group by word),
prior as (select word, exp(m) / sum(exp(m)) over () as prior from means){extra},
best as ({predictions}),
e as (select {EVALUATION_COLUMNS} from cut join best using (text, label) where quality = 0)
select 'ToxiGen' as dataset, 0 as template_id, 10 as shot, 'manual' as verbalizer, round(accuracy, 6) as accuracy, round(precision, 6) as precision,
  round(recall, 6) as recall from e"""


_WORD_SCORE_SQL = "('0x' || substr(md5(prompt || word), 1, 8))::bigint / 4294967296.0 + length(prompt) % 3 * class_id"


def _few_shot_files(spark, sf) -> str:
    """The files of a known dataset below one folder: train and test rows, a template and label words."""
    root = scratch_path(spark, "few-shot")
    rows = fx_labeled(spark, sf)
    for split, quality in (("train", 1), ("test", 0)):
        part = rows.where(F.col("quality") == quality).select("label", "text")
        sinks.write_labeled_csv(part, f"{root}/{catalog.find_dataset('ToxiGen').folder}/{split}.csv")
    scripts = f"{root}/{catalog.find_dataset('ToxiGen').scripts}"
    sinks.write_log_lines(spark.range(1).select(F.lit(_FEW_SHOT_TEMPLATE).alias("value")), f"{scripts}/manual_template.txt")
    sinks.write_log_lines(spark.range(1).select(F.lit("abuse,insult\nkind,calm").alias("value")), f"{scripts}/manual_verbalizer.txt")
    return root


def _word_logit(prompt, word):
    """A stub for the model: a number from the prompt and the word, higher for words of class 1 on some prompts."""
    number = F.conv(F.substring(F.md5(F.concat(prompt, word)), 1, 8), 16, 10).cast("double") / 4294967296
    return number + F.length(prompt) % 3 * F.when(word.isin("abuse", "insult"), 1).otherwise(0)


def _few_shot_record(record):
    metrics = [F.round(n, 6).alias(n) for n in ("accuracy", "precision", "recall")]
    return record.select("dataset", "template_id", "shot", "verbalizer", *metrics)


# log probabilities of the words, divided by the prior; to be formatted with a table of prompts and its columns
_CALIBRATED_LOGS_SQL = f"""raw as (select {{keys}}, word, class_id, {_WORD_SCORE_SQL} as logit from {{table}} cross join lexicon),
logs as materialized (
  select {{keys}}, word, class_id, ln(ratio / sum(ratio) over (partition by {{keys}}) + 1e-15) as l
  from (select *, exp(logit) / sum(exp(logit)) over (partition by {{keys}}) / prior as ratio from raw join prior using (word)))"""
_CALIBRATED_SQL = f""",
{_CALIBRATED_LOGS_SQL.format(table="test", keys="text, label")},
classes as (select text, label, class_id, avg(l) as s from logs group by 1, 2, 3)"""


@query(_few_shot_sql(_CALIBRATED_SQL, "select text, label, arg_max(class_id, struct_pack(s := round(s, 12), c := -class_id)) as pred from classes group by 1, 2"))
def few_shot_run(spark, sf):
    """From the files of a known dataset to the record of a calibrated run, with a stub as the model."""
    root = _few_shot_files(spark, sf)
    return _few_shot_record(classify.few_shot_run(spark, root, root, "ToxiGen", _word_logit))


# -- sinks --------------------------------------------------------------------------------------


_ODD_SQL = """case length(text) % 5 when 0 then '' when 1 then '  ' || text || ' ' || chr(10) || ' ' when 2 then '"' || text || '", "more' else text || ' more' end"""


@query(f"""with {FX_LABELED}
select {CLASS_NAME} as cyberbullying_type, {_ODD_SQL} as tweet_text, case when length(text) % 4 = 0 then null else lang end as lang from fx_labeled""")
def append_batches(spark, sf):
    """Texts with blanks at their ends, quotes, line breaks, empty texts and nulls, through CSV and back."""
    path = scratch_path(spark, "augmented")
    text, rest = F.col("text"), F.length("text") % 5
    odd = (
        F.when(rest == 0, "")
        .when(rest == 1, F.concat(F.lit("  "), text, F.lit(" \n ")))
        .when(rest == 2, F.concat(F.lit('"'), text, F.lit('", "more')))
        .otherwise(F.concat(text, F.lit(" more")))
    )
    lang = F.when(F.length("text") % 4 != 0, F.col("lang"))
    rows = fx_labeled(spark, sf).select("quality", _class_name().alias("cyberbullying_type"), odd.alias("tweet_text"), lang.alias("lang"))
    for quality in (0, 1):
        batch = rows.where(F.col("quality") == quality).drop("quality")
        sinks.append_rows(batch, path, "csv", first=quality == 0)
    return read_written(spark, path, "csv")


@query(f"""
with lines as (select unnest(string_split(text, chr(10))) as line from documents)
select {CLEAN_COMMAS_SQL} as line from lines""")
def clean_text_lines(spark, sf):
    raw, cleaned = scratch_path(spark, "lines"), scratch_path(spark, "lines-cleaned")
    table(spark, sf, "documents").select("text").write.text(raw)
    sinks.clean_text_file(spark, raw, cleaned)
    return spark.read.text(cleaned).withColumnRenamed("value", "line")


RUN = {"dataset": "tweets", "template_id": 0, "seed": SEED, "shot": 10, "verbalizer": "manual", "calibration": False,
       "filter": "none", "max_token_split": -1, "kptw_lr": 0.06}


@query(f"""with p as (select toxic as label, 1 - quality as pred from labels), e as (select {EVALUATION_COLUMNS} from p)
select 'tweets' as dataset, 0 as template_id, {SEED} as seed, 10 as shot, 'manual' as verbalizer, round(accuracy, 6) as accuracy,
  round(rmse, 6) as rmse, round(mae, 6) as mae, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from e""")
def run_record(spark, sf):
    path = scratch_path(spark, "runs")
    sinks.write_run_record(RUN, evaluate(fx_preds(spark, sf)), path)
    metrics = [F.round(n, 6).alias(n) for n in ("accuracy", "rmse", "mae", "precision", "recall", "f1")]
    return spark.read.parquet(path).select("dataset", "template_id", "seed", "shot", "verbalizer", *metrics)
