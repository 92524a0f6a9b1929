"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed place in [0, 2^60): the leading bits of the MD5 of its key. A source takes
the documents below a threshold, so a smaller budget always takes a subset of what a larger one takes.
The threshold comes from sums of tokens by source and hash bucket. Only the bucket in which the budget
ends is looked at again, in finer buckets, until its documents have nothing left to tell them apart.
Nothing is sorted or ranked; a round is one aggregation of short rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from augspark.operators.skew import broadcast_if_small
from augspark.session import cut_lineage

# Hex digits of the MD5 that place a document, and how many of them a round of buckets uses
PLACE_DIGITS = 15
ROUND_DIGITS = 3
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash_place(key: Column, seed: str) -> Column:
    """The key's place as a 15-digit hexadecimal string; null has a place of its own."""
    return F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), F.lit(PLACE_DIGITS))


def source_targets(sizes: DataFrame, cycle: Sequence[int] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources from a table (source, source_size) with one row per source.

    Weights repeat ``cycle`` over the sources in code point order, null last. The sum of all sizes is shared
    by weight; a source that would get more than ``max_epochs`` times its size stops there, and the excess
    is shared anew. The sources that stop are those with the lowest size per weight, so one pass in that
    order finds them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(c)) for c in cycle]), at).cast("bigint"))
    cap = (F.col("source_size") * max_epochs).cast("bigint")
    whole = Window.partitionBy()
    order = Window.orderBy((cap / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        named.withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        # the source stops at its cap if even its share of what is left exceeds it
        .withColumn("stops", F.col("left") * F.col("weight") > F.col("cap") * F.col("open_weight"))
    )
    free = (
        ranked.withColumn("rest", F.max(F.when(~F.col("stops"), F.col("left"))).over(whole))
        .withColumn("rest_weight", F.max(F.when(~F.col("stops"), F.col("open_weight"))).over(whole))
    )
    share = F.col("rest").cast("double") * F.col("weight").cast("double") / F.col("rest_weight").cast("double")
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share)
    return free.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
    cycle: Sequence[int] = CYCLE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """One row per document: key, size, source, source_size, target, copies and taken (words, repeats counted).

    A source takes every document ``floor(target / source_size)`` times and the documents below the
    threshold once more. The place in which the budget ends is taken if that comes closer to the target, so a
    source misses it by half of one place at most. Documents with equal keys share a place and are taken
    together. Empty texts have size 0, an empty table gives an empty result. The
    result is a function of the rows alone; order and partitioning do not matter.
    """
    place = hash_place(F.col(key), seed)
    narrow = cut_lineage(
        docs.select(
            F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), place.alias("place")
        )
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = _stored(
        source_targets(sizes, cycle, max_epochs)
        # full copies of everything, then the budget of the last, partial one
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .withColumn("prefix", F.lit(""))
        .withColumn("edge", F.lit(0).cast("bigint"))
    )
    for digits in range(ROUND_DIGITS, PLACE_DIGITS + 1, ROUND_DIGITS):
        state = _stored(_refine(narrow, state, digits))
    closer = (F.col("place") == F.col("prefix")) & (2 * F.col("budget") > F.col("edge"))
    below = F.when((F.left("place", F.length("prefix")) < F.col("prefix")) | closer, 1).otherwise(0)
    joined = narrow.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    copies = (F.col("epochs") + below).cast("bigint")
    return joined.select(
        F.col("_key").alias(key), "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def _stored(state: DataFrame) -> DataFrame:
    """A row per source, stored; broadcast after a look at its size, so that documents are not shuffled by source."""
    return broadcast_if_small(cut_lineage(state))[0]


def _refine(narrow: DataFrame, state: DataFrame, digits: int) -> DataFrame:
    """The boundary prefix of every source, made ``ROUND_DIGITS`` longer, its tokens, and what is left of the budget.

    Places below the prefix are taken. At most 16^ROUND_DIGITS buckets a source come out of the histogram.
    """
    edge = state.select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix"))
    inside = narrow.join(
        edge, F.col("source").eqNullSafe(F.col("_source")) & (F.left("place", F.length("_prefix")) == F.col("_prefix"))
    )
    histogram = inside.groupBy("source", F.left("place", F.lit(digits)).alias("bucket")).agg(F.sum("size").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    sums = histogram.withColumn("upto", running)
    known = state.withColumnRenamed("source", "_source")
    fits = sums.join(known, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("upto") <= F.col("budget"))
    # the buckets that fit come first, since sums only grow; the boundary is the first one that does not
    taken = fits.groupBy("source").agg(F.max("upto").alias("_taken"))
    beyond = (
        sums.join(known.select("_source", "budget"), F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("upto") > F.col("budget"))
        .groupBy("source")
        .agg(F.min("bucket").alias("_bucket"), F.min_by("tokens", "bucket").alias("_edge"))
    )
    out = known.join(taken, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
    out = out.join(beyond, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
    # without a boundary bucket the whole rest fits: a prefix above all hexadecimal digits
    prefix = F.when(F.col("prefix") == "g", F.lit("g")).otherwise(F.coalesce(F.col("_bucket"), F.lit("g")))
    return out.select(
        F.col("_source").alias("source"),
        "source_size",
        "target",
        "epochs",
        (F.col("budget") - F.coalesce(F.col("_taken"), F.lit(0))).alias("budget"),
        prefix.alias("prefix"),
        F.coalesce("_edge", F.lit(0)).alias("edge"),
    )


def apply_mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents as often as the mix takes them; columns as given. Rows with equal keys go together."""
    source = options.get("source", "source")
    mixed = mix_sources(docs, key=key, **options).where(F.col("copies") > 0)
    mixed = mixed.select(F.col(key).alias("_mix_key"), F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies")).distinct()
    repeated = docs.join(mixed, F.col(key).eqNullSafe(F.col("_mix_key")) & F.col(source).eqNullSafe(F.col("_mix_source")))
    return repeated.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix_copies"))).select(*docs.columns)


def mix_sql() -> str:
    """DuckDB SQL of the mix: the documents of a source in the order of their places, up to the budget."""
    return r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         left(md5(concat('mix:', coalesce(doc_id::varchar, 'null'))), 15) as place
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as weight from s),
c as (select *, source_size * 3 as cap from w),
r as (
  select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as lft,
         sum(weight) over (order by cap / weight, source is null, encode(source) rows between current row and unbounded following) as open_weight
  from c),
st as (select *, lft * weight > cap * open_weight as stops from r),
f as (select *, max(case when not stops then lft end) over () as rest, max(case when not stops then open_weight end) over () as rest_weight from st),
t as (select source, source_size, case when stops then cap::double else rest::double * weight::double / rest_weight::double end as target from f),
e as (select *, (case when source_size > 0 then floor(target / source_size) else 0 end)::bigint as epochs from t),
b as (select *, floor(target - epochs * source_size)::bigint as budget from e),
p as (select source, place, sum(size) as size from d group by source, place),
q as (select *, sum(size) over (partition by source order by place) as upto from p)
select d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.epochs + case when 2 * q.upto - q.size < 2 * b.budget then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source
join q on q.source is not distinct from d.source and q.place = d.place
"""
