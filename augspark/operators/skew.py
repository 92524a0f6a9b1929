"""Group-wise operations that stay spread out when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from augspark.session import cut_lineage

# A group up to this size is handled by one task as a whole
GROUP_LIMIT = 10_000
# Tables of a few numbers per row are broadcast up to this many rows
BROADCAST_ROWS = 1_000_000
# ... and this many bytes, keys and carried columns included
BROADCAST_BYTES = 256 << 20
# Leading hex digits of a hash: 16^4 buckets, which is also the size of the table of bucket counts
HASH_DIGITS = 4
# Keys that a frequency sketch follows; a key with more than about 4 / SKETCH_KEYS of the rows is found
SKETCH_KEYS = 10_000
MAX_HEAVY_KEYS = 1_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null, as in grouping; the key columns of the left side remain."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """A table with a broadcast hint if it has up to ``limit`` rows and BROADCAST_BYTES bytes, and its number of rows."""
    small, rows = _fits(df, limit)
    return (F.broadcast(df) if small else df), rows


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has up to ``limit`` rows and BROADCAST_BYTES bytes."""
    return _fits(df, limit)[0]


def _fits(df: DataFrame, limit: int) -> tuple[bool, int]:
    rows, size = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES, rows


def lowest_per_group(df: DataFrame, keys: Sequence[str], digest: Column, key: str, n: int, name: str = "rank") -> DataFrame:
    """The ``n`` rows of each group with the lowest ``digest``, then ``key``, with their rank; digest: hexadecimal text.

    Rows are counted by group and leading digits of the digest, which leaves HASH_DIGITS digits per group
    and task to be exchanged. Only rows up to the digits that hold the n-th row of their group are ranked: n
    rows and what shares the last digits with them, whatever the size of the group.
    """
    marked = df.withColumn("_digest", digest).withColumn("_digits", F.left("_digest", F.lit(HASH_DIGITS)))
    counts = marked.groupBy(*keys, "_digits").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy(*keys).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(order), F.lit(0))
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(*keys).agg(F.max("_digits").alias("_last"))
    last, _ = broadcast_if_small(cut_lineage(last))
    near = join_keys(marked, last, keys).where(F.col("_digits") <= F.col("_last"))
    ranked = near.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("_digest", key)).cast("bigint"))
    return ranked.where(F.col(name) <= n).select(*df.columns, name)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for each plain value, else its length."""
    widths = [F.lit(8)]
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)))
        else:
            widths.append(F.lit(8))
    return reduce(lambda a, b: a + b, widths).cast("bigint")


def stored_side(df: DataFrame) -> DataFrame:
    """A table of one short row per key, stored once, and broadcast in joins if its count allows that."""
    return broadcast_if_small(cut_lineage(df))[0]


def split_by_group_size(
    df: DataFrame, keys: Sequence[str], limit: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit`` rows (GROUP_LIMIT by default), and those of larger groups or None.

    Sizes come from a count of the key columns only, run when the plan is built. The large keys are few,
    so the rows are normally told apart where they are, without a shuffle. ``df`` is read more than
    once, so it should be a stored table, not the output of a sampling model.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large_keys = cut_lineage(sizes.where(F.col("_rows") > (limit or GROUP_LIMIT)).select(*keys))
    large_keys, rows = broadcast_if_small(large_keys)
    if rows == 0:
        return df, None
    return join_keys(df, large_keys, keys, "left_anti"), join_keys(df, large_keys, keys, "left_semi")


def heavy_hashes(df: DataFrame, keys: Sequence[str], limit: int) -> list[int]:
    """Hashes of the keys that hold more than ``limit`` rows and a notable share of all rows.

    Found with a frequency sketch per task, merged in two steps, so the keys are not shuffled.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("g"))
    sketches = hashed.groupBy("g").agg(F.call_function("approx_top_k_accumulate", "h", F.lit(SKETCH_KEYS)).alias("s"))
    merged = F.call_function("approx_top_k_combine", F.col("s"), F.lit(SKETCH_KEYS))
    estimate = F.call_function("approx_top_k_estimate", merged, F.lit(MAX_HEAVY_KEYS))
    # grouped by a constant, since an empty table has no sketch to merge
    top = sketches.groupBy(F.lit("all")).agg(estimate.alias("top"))
    found = top.select(F.inline("top")).where(F.col("count") > limit)
    return [r["item"] for r in found.collect()]  # at most MAX_HEAVY_KEYS


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position of every row in the given order, without a single-task sort.

    Rows are range-partitioned, sorted inside each partition and stored; the position is the place in
    the partition plus the sizes of the partitions before it. ``order`` should end in a unique column.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    partition, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    sizes = {r["p"]: r["n"] for r in placed.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, seen = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(seen)
        seen += sizes.get(p, 0)
    start = F.element_at(F.lit(starts).cast("array<bigint>"), (partition + 1).cast("int"))
    return placed.withColumn(name, start + place).drop("_at")


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    limit: int | None = None,
) -> DataFrame:
    """``row_number()`` per key (1-based, bigint).

    Groups that are both above ``limit`` rows (GROUP_LIMIT by default) and a notable share of the table
    are ranked by a global sort, the others by a window. Which way a group goes does not change its ranks.
    """
    heavy = heavy_hashes(df, keys, limit or GROUP_LIMIT)
    window = Window.partitionBy(*keys).orderBy(*order)
    rank = F.row_number().over(window).cast("bigint")
    if not heavy:
        return df.withColumn(name, rank)
    is_heavy = F.xxhash64(*keys).isin(heavy)
    placed = global_position(df.where(is_heavy), [*map(F.col, keys), *order], "_pos")
    first = stored_side(placed.groupBy(*keys).agg(F.min("_pos").alias("_first")))
    ranked = join_keys(placed, first, keys).select(*df.columns, (F.col("_pos") - F.col("_first") + 1).alias(name))
    return df.where(~is_heavy).withColumn(name, rank).unionByName(ranked)


def seeded_hash(key: Column, seed: int) -> Column:
    """Hex digest that orders rows at random, but the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hashed_position(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """0-based position of every row in the order of ``seeded_hash(key)``; ``key`` is unique.

    The leading digits of the digest cut the rows into even, ordered buckets, so each bucket is ranked
    by itself and shifted by the size of the buckets before it.
    """
    digest = seeded_hash(F.col(key), seed)
    hashed = df.withColumn("_digest", digest).withColumn("_bucket", F.left("_digest", F.lit(HASH_DIGITS)))
    counts = (
        df.select(F.left(digest, F.lit(HASH_DIGITS)).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key)) - 1
    # at most 16^HASH_DIGITS rows on the right
    return (
        hashed.withColumn("_place", place)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .select(*df.columns, name)
    )


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    Up to the optimizer's group-limit threshold every map task keeps n rows per group before the
    shuffle; for larger n the groups themselves may be large and are ranked by :func:`row_numbers`.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n <= threshold:
        window = Window.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumn(name, F.row_number().over(window).cast("bigint"))
    else:
        ranked = row_numbers(df, keys, order, name)
    return ranked.where(F.col(name) <= n)
