"""Uncertainty scores of generated text from tables of logits, hidden states and attention rows.

Tables have one row per token (and layer, head): ``logits(sample_id, pos, logits)``,
``hidden(sample_id, layer, pos, vec)``, ``attention(sample_id, layer, head, pos, row)``. The tokens to
score come as ``spans(sample_id, start, end)`` with ``start <= pos < end``; without spans all tokens of
the table are scored, which saves the join where the writer has already left out the prompt's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from augspark.functions.scoring import (
    INF,
    NAN,
    RIDGE,
    let,
    log_det_score,
    mean_log_singular_value,
    mean_token_entropy_arrow,
    safe_log,
    self_attention_score,
    top_entropy,
    top_entropy_arrow,
)
from augspark.operators.skew import fits_broadcast, split_by_group_size
from augspark.operators.tiles import TILE, log_determinants, product_tiles
from augspark.session import cut_lineage

# Fixed values of the metrics
DIAGONAL_EPSILON = 1e-12
DEFAULT_TOP_K = 50

# Samples with more tokens than this are scored through the d x d matrix instead of the t x t one
MAX_GRAM_TOKENS = 4_096
# ... which is cut into tiles if vectors are longer than this
MAX_GRAM_WIDTH = 4_096


@dataclass(frozen=True)
class StoredSpans:
    """Spans stored once, with what all scores want to know of them.

    table: (sample_id, start, end), with a broadcast hint if it is ``small``. longest: the tokens of the
    longest span.
    """

    table: DataFrame
    small: bool
    longest: int


def stored_spans(spans: DataFrame | StoredSpans) -> StoredSpans:
    """Stores three columns of the spans and looks at them once; the scores need no further job to be planned."""
    if isinstance(spans, StoredSpans):
        return spans
    table = cut_lineage(spans.select("sample_id", "start", "end"))
    small = fits_broadcast(table)
    longest = table.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    return StoredSpans(F.broadcast(table) if small else table, small, longest or 0)


def in_span() -> Column:
    return (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))


def span_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of a per-token table that lie in the span of their sample."""
    return tokens.join(spans, "sample_id").where(in_span()).drop("start", "end")


def middle_layer(table: DataFrame, num_layers: int) -> DataFrame:
    """The rows of layer ``num_layers // 2``; prunes files when the table is partitioned by layer."""
    return table.where(F.col("layer") == num_layers // 2)


# -- logit entropy ------------------------------------------------------------------------------


def logit_entropy(
    logits: DataFrame,
    spans: DataFrame | StoredSpans | None = None,
    top_k: int | None = None,
    normalize: str = "mean",
    wide: bool | None = None,
) -> DataFrame:
    """Mean of -p log p over the tokens of a span and the ``top_k`` entries of each.

    ``normalize='sum'`` gives the plain entropy averaged over tokens instead. ``wide`` sends the logits
    to Python in Arrow batches and selects the largest without sorting them all, which is the faster way
    at any width and so the default when there is a ``top_k``. A sample whose span is empty gets NaN; a sample without
    any logits is not returned.
    """
    if wide is None:
        wide = top_k is not None
    entropy = (top_entropy_arrow if wide else top_entropy)(F.col("logits"), top_k)
    width = F.size("logits") if top_k is None else F.least(F.size("logits"), F.lit(top_k))
    weight = {"mean": width, "sum": F.lit(1)}[normalize]
    known = stored_spans(spans) if spans is not None else None
    if known is None:
        scored = logits.select("sample_id", entropy.alias("h"), weight.alias("w"))
    elif known.small:
        # no shuffle before the aggregate, and tokens outside their span are not scored
        inside = logits.join(known.table, "sample_id").withColumn("logits", F.when(in_span(), F.col("logits")))
        scored = inside.select("sample_id", entropy.alias("h"), weight.alias("w"))
    else:
        # the join would shuffle the logits, so each token is reduced to two numbers first
        tokens = logits.select("sample_id", "pos", entropy.alias("h"), weight.alias("w"))
        scored = tokens.join(known.table, "sample_id").withColumn("h", F.when(in_span(), F.col("h")))
    weights = F.sum(F.when(F.col("h").isNotNull(), F.col("w")))
    score = F.coalesce(F.sum("h") / weights, F.lit(NAN))
    return scored.groupBy("sample_id").agg(score.alias("logit_entropy"))


# -- centred log-determinant --------------------------------------------------------------------


def _vectors(table: pa.Table) -> np.ndarray:
    """Token vectors as rows."""
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(table.num_rows, -1)


def _gram_score(table: pa.Table) -> pa.Table:
    inside = table.drop_null()
    score = mean_log_singular_value(_vectors(inside)) if inside.num_rows else NAN
    return pa.table({"sample_id": table.column("sample_id")[:1], "svd_score": [score]})


# Bytes of d x d sums that a task holds at once
_HELD_BYTES = 256 << 20


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and sample: the rows of the sum of outer products of its vectors."""
    sums: dict[object, list] = {}
    id_type = None

    def rows() -> Iterator[pa.RecordBatch]:
        while sums:
            sample, (products, tokens) = sums.popitem()
            d = len(products)
            flat = pa.array(products.ravel())
            columns = {
                "sample_id": pa.array([sample] * d, id_type),
                "i": pa.array(range(d), pa.int32()),
                "products": pa.ListArray.from_arrays(pa.array(range(0, d * d + 1, d), pa.int32()), flat),
                "tokens": pa.array([tokens] * d, pa.int64()),
            }
            yield pa.record_batch(columns)

    for batch in batches:
        batch = batch.drop_null()
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        id_type = batch.schema.field(0).type
        codes = batch.column(0).dictionary_encode(null_encoding="encode")
        index = codes.indices.to_numpy(zero_copy_only=False)
        z = _vectors(table)
        z = z - z.mean(axis=1, keepdims=True)
        for code, sample in enumerate(codes.dictionary.to_pylist()):
            part = z[index == code]
            held = sums.setdefault(sample, [0.0, 0])
            held[0] = held[0] + part.T @ part
            held[1] += len(part)
            # before the next matrix is made: at most one more than the limit allows is held
            if (len(sums) + 1) * 8 * z.shape[1] ** 2 > _HELD_BYTES:
                yield from rows()
    yield from rows()


def _product_score(table: pa.Table) -> pa.Table:
    products = table.sort_by("i").column("products").combine_chunks()
    d = table.num_rows
    c = products.flatten().to_numpy(zero_copy_only=False).reshape(d, d)
    t = table.column("tokens")[0].as_py()
    # det(ZZ' + aI_t) = a^(t-d) det(Z'Z + aI_d)
    logdet = (t - d) * np.log(RIDGE) + np.linalg.slogdet(c + RIDGE * np.eye(d))[1]
    return pa.table({"sample_id": table.column("sample_id")[:1], "svd_score": [logdet / t]})


def _large_scores(large: DataFrame, schema: str, id_type: str, max_width: int, tile: int) -> DataFrame:
    """Scores of samples through their d x d matrices."""
    width = large.agg(F.max(F.size("vec"))).first()[0] or 0
    if width > max_width:
        tiles = cut_lineage(product_tiles(large, tile, RIDGE))
        tokens = tiles.where("i = 0 and j = 0").select(F.col("sample_id").alias("_id"), "tokens")
        found = log_determinants(tiles, tile).join(tokens, F.col("sample_id").eqNullSafe(F.col("_id")))
        # as in _product_score
        score = ((F.col("tokens") - F.col("d")) * float(np.log(RIDGE)) + F.col("log_determinant")) / F.col("tokens")
        return found.select("sample_id", score.alias("svd_score"))
    partial = large.mapInArrow(_partial_products, f"sample_id {id_type}, i int, products array<double>, tokens bigint")
    summed = partial.groupBy("sample_id", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"),
        F.sum("tokens").alias("tokens"),
    )
    return summed.groupBy("sample_id").applyInArrow(_product_score, schema)


def svd_score(
    hidden: DataFrame,
    spans: DataFrame | StoredSpans | None,
    layer: int,
    max_tokens: int = MAX_GRAM_TOKENS,
    max_width: int = MAX_GRAM_WIDTH,
    tile: int = TILE,
) -> DataFrame:
    """Mean log singular value of the ridged Gram matrix of a span's centred token vectors.

    Samples above ``max_tokens`` are reduced to d x d sums of outer products, added up per task before
    the shuffle and then row by row of the matrix. Where such vectors are longer than ``max_width``, no task
    holds a whole matrix: products and decomposition go tile by tile (see :mod:`augspark.operators.tiles`).
    """
    tokens = hidden.where(F.col("layer") == layer).select("sample_id", "pos", "vec")
    id_type = hidden.schema["sample_id"].dataType.simpleString()
    schema = f"sample_id {id_type}, svd_score double"
    if spans is None:
        small, large = split_by_group_size(tokens.select("sample_id", "vec"), ["sample_id"], max_tokens)
    else:
        known = stored_spans(spans)
        # a row outside its span loses its vector but tells that the sample has rows, which gives NaN
        inside = tokens.join(known.table, "sample_id").withColumn("vec", F.when(in_span(), F.col("vec")))
        is_large = F.col("end") - F.col("start") > max_tokens
        small, large = inside.select("sample_id", "vec"), None
        if known.longest > max_tokens:
            large = inside.where(is_large & F.col("vec").isNotNull()).select("sample_id", "vec")
            small = inside.where(~is_large | F.col("vec").isNull()).select("sample_id", "vec")
    scores = small.groupBy("sample_id").applyInArrow(_gram_score, schema)
    if large is not None:
        scores = scores.unionByName(_large_scores(large, schema, id_type, max_width, tile))
    if large is None or spans is None:
        return scores
    # of a large sample, the rows outside its span have given NaN beside its score
    return scores.groupBy("sample_id").agg(F.coalesce(F.min(F.when(~F.isnan("svd_score"), F.col("svd_score"))), F.lit(NAN)).alias("svd_score"))


# -- attention diagonal -------------------------------------------------------------------------


def own_attention(attention: DataFrame) -> Column:
    """Attention of a token to itself: column ``own`` if the table has it, which spares reading whole rows."""
    own = F.col("own") if "own" in attention.columns else F.col("row")[F.col("pos")]
    return own.cast("double")


def attention_score(attention: DataFrame, spans: DataFrame | StoredSpans | None, layer: int) -> DataFrame:
    """Sum over heads of the mean log self-attention of the span's tokens."""
    tokens = attention.where(F.col("layer") == layer).select(
        "sample_id", "head", "pos", safe_log(own_attention(attention)).alias("log_own")
    )
    if spans is not None:
        tokens = tokens.join(stored_spans(spans).table, "sample_id").withColumn("log_own", F.when(in_span(), F.col("log_own")))
    heads = tokens.groupBy("sample_id", "head").agg(F.avg("log_own").alias("head_mean"))
    # an average over no token is NaN
    total = F.sum(F.coalesce("head_mean", F.lit(NAN)))
    return heads.groupBy("sample_id").agg(total.alias("attn_eig"))


def attention_diagonal(
    attention: DataFrame, layer: int, head: int, start: int, end: int, sample_id: int | None = None
) -> DataFrame:
    """Log self-attention per token position in ``[start, end)``, of one sample or of all."""
    rows = attention.where(
        (F.col("layer") == layer) & (F.col("head") == head) & (F.col("pos") >= start) & (F.col("pos") < end)
    )
    if sample_id is not None:
        rows = rows.where(F.col("sample_id") == sample_id)
    return rows.select("sample_id", "pos", F.ln(own_attention(attention) + DIAGONAL_EPSILON).alias("log_diagonal"))


# -- all of them --------------------------------------------------------------------------------


def calculate_metrics(
    spans: DataFrame,
    logits: DataFrame,
    hidden: DataFrame | None,
    attention: DataFrame | None,
    layer: int,
    top_k: int | None = None,
    wide: bool | None = None,
    strict: bool = True,
) -> DataFrame:
    """All three scores for every sample of ``spans``.

    A sample without hidden states or attention in the layer scores 0.0 there; an empty span scores
    NaN. A sample without logits fails the job, or when not ``strict`` is left out, so that
    :func:`attach_scores` treats it as failed.
    """
    spans = stored_spans(spans)
    entropy = logit_entropy(logits, spans, top_k, wide=wide)
    out = spans.table.select("sample_id").join(entropy, "sample_id", "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no logits for sample "), F.col("sample_id").cast("string")))
        out = out.withColumn("logit_entropy", F.coalesce("logit_entropy", missing.cast("double")))
    for table, score, name in ((hidden, svd_score, "svd_score"), (attention, attention_score, "attn_eig")):
        if table is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            out = out.join(score(table, spans, layer), "sample_id", "left").withColumn(
                name, F.coalesce(name, F.lit(0.0))
            )
    return out.select("sample_id", "svd_score", "attn_eig", "logit_entropy")


def in_array_span(values: Column, start: Column, end: Column) -> Column:
    """Entries ``[start, end)`` of an array by token."""
    return F.slice(values, start + 1, F.greatest(end - start, F.lit(0)))


def metrics_from_arrays(df: DataFrame, top_k: int | None = None) -> DataFrame:
    """All three scores where each sample is one row; nothing is shuffled, so it works on streams.

    Columns: ``start`` and ``end`` of the span, ``logits`` (logits per token), ``vectors`` (hidden state of
    one layer per token) and ``own`` (self-attention per head and token). Null vectors or attention score
    0.0, an empty span NaN. A null inside an array is a token that is missing, as is a row that
    :func:`calculate_metrics` does not find.
    """
    start, end = F.col("start"), F.col("end")
    own = let(
        F.struct("own", "start", "end"),
        lambda g: F.transform(g["own"], lambda values: in_array_span(values, g["start"], g["end"])),
    )
    logits = F.filter(in_array_span(F.col("logits"), start, end), lambda x: x.isNotNull())
    return df.withColumns(
        {
            "svd_score": F.coalesce(log_det_score(in_array_span(F.col("vectors"), start, end)), F.lit(0.0)),
            "attn_eig": F.coalesce(self_attention_score(own), F.lit(0.0)),
            "logit_entropy": mean_token_entropy_arrow(logits, top_k),
        }
    ).drop("start", "end", "logits", "vectors", "own")


def attach_scores(candidates: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """Scores of each candidate; a candidate without a valid one gets (inf, 0, 0) and an empty prompt."""
    joined = candidates.join(scores, on, "left")
    failed = F.col("svd_score").isNull() | F.isnan("svd_score")
    blank = {"svd_score": INF, "attn_eig": 0.0, "logit_entropy": 0.0, "full_prompt": ""}
    return joined.withColumns(
        {c: F.when(failed, F.lit(x)).otherwise(F.col(c)) for c, x in blank.items() if c in joined.columns}
    )
