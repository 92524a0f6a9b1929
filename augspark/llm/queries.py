"""The registered queries of this subpackage, with their SQL where SQL can express them.

Each applies its operator with production parameters to its whole table and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augspark.llm.context_tree import language_scores
from augspark.llm.embedding_graph import near_vector_groups
from augspark.llm.html_text import extract_text
from augspark.llm.mixing import mix_sources, mix_sql
from augspark.llm.packing import pack
from augspark.llm.periodic_runs import periodic_runs
from augspark.llm.quality import fit_quality, rate_quality
from augspark.llm.simhash import simhash_groups
from augspark.llm.suffix_dedup import remove_repeats
from augspark.llm.toxicity import fit_toxicity, score_toxicity
from augspark.llm.vector_codes import vector_codes, with_error_per_label
from augspark.llm.warc import read_archives, resolved, write_archives
from augspark.llm.winnowing import compare_with_edits
from augspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# Rows of an Arrow batch: texts have kilobytes, so Spark's default of 10,000 would hold tens of megabytes
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows per Arrow batch to BATCH_ROWS, unless somebody has chosen another number than the default."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """CRC-32 of the key as text, modulo the number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = rate_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


@query
def op2_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=fold("_key", 5) != 0)
    scored = score_toxicity(docs.select("doc_id", "text"), machine)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path, with_payload=False)).withColumnRenamed("key", "page_id")


@query
def op5_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = extract_text(table(spark, sf_dir, "pages"))
    return extracted.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op6_simhash_point_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op7_embedding_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vector_groups(table(spark, sf_dir, "embeddings"))


@query
def op8_language_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    held_out = (fold("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")


@query
def op9_mix_hash_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op9_mix_hash_threshold"] = mix_sql()


@query
def op10_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) is divisible by 10, the words from some place on repeat a few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    planted = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("bigint"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1
    planted = planted.withColumn("p", period)
    changed = F.expr("array_join(transform(sequence(0L, n - 1), i -> get(w, int(if(i < a, i, a + (i - a) % p)))), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query
def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so the first of equal ones stays
    best = F.expr(
        "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), "
        "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _marked(column: str) -> Column:
    """(position, hash) pairs as text: decimal position, colon, eight hexadecimal digits, joined by commas."""
    mark = lambda m: F.concat(m["position"].cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(m["hash"]), 8, "0")))
    return F.array_join(F.transform(column, mark), ",")


@query
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = compare_with_edits(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _marked("fingerprint").alias("fingerprint"),
        _marked("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op13_adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes(table(spark, sf_dir, "embeddings"), label="label")
    return with_error_per_label(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql() -> str:
    """Two rounds and a last assignment, over vectors whose parts have four components, each part compared with all entries."""
    parts = """
with kept as (
  select vec_id, label, embedding, row_number() over (order by vec_id) as rn from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (
  select vec_id, label, rn, p, """ + ", ".join(f"floor(256 * embedding[4 * p + {i + 1}]::double)::bigint as x{i}" for i in range(4)) + """
  from kept, range(16) t(p)),
book0 as materialized (select p, rn - 1 as e, x0, x1, x2, x3 from parts where rn <= 64)"""
    distance = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(4))
    out = parts
    for r in range(3):
        out += f""",
near{r} as materialized (
  select a.vec_id, a.label, a.p, a.x0, a.x1, a.x2, a.x3, b.e, {distance} as d from parts a join book{r} b using (p)
  qualify row_number() over (partition by a.vec_id, a.p order by d, b.e) = 1)"""
        if r < 2:
            means = ", ".join(f"floor(sum(x{i})::double / count(*))::bigint as m{i}" for i in range(4))
            moved = ", ".join(f"coalesce(m{i}, x{i}) as x{i}" for i in range(4))
            out += f""",
book{r + 1} as materialized (
  select b.p, b.e, {moved} from book{r} b left join (select p, e, {means} from near{r} group by p, e) m using (p, e))"""
    return out + """,
codes as (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near2 group by vec_id),
digest as (select sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' order by p, e)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from codes, digest"""


ORACLE_SQL["op13_adaptive_bounds"] = _codes_sql()
