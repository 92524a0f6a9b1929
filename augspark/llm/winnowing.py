"""Document fingerprints by winnowing, in built-in functions only.

Every k-gram of a text's UTF-8 bytes has a hash: its CRC-32, the remainder that a rolling checksum
carries from place to place. Of every window of w consecutive hashes the smallest is chosen, the
rightmost of equal ones. Any k + w - 1 bytes that two texts share give both a common chosen hash, and
the kept positions say where.

Texts are cut into stretches of bytes that overlap by k + w - 2, one row each, so that every window
lies whole in exactly one row. The minima of a row's windows follow from minima over 4, 16, ...
neighbours, each level a plain projection of as many columns as the row has hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from augspark.operators.skew import global_position

GRAM, WINDOW = 16, 32
# Windows of a row, and bytes of a text that are cut into such rows at a time. Rows of over 100 columns are
# projected by many small methods instead of one, which would be too long for the JVM to compile.
STRETCH, SEGMENT = 128, 1 << 16
# How many minima of one level make one of the next
FAN = 6
# A hash and its place in one number: the smaller number has the smaller hash, or else the later place
_PLACES = 1 << 31
# Rows that a repeated row is first dealt out to, before each of them is repeated
_REPEAT = 10_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(data: Column, start: Column, step: int, size: int) -> Column:
    """(base, data) of the pieces of ``size`` bytes at every ``step`` bytes; ``start``: the place of the first byte."""

    def cut(b: Column) -> Column:
        last = F.floor((F.octet_length(b) - 1) / step)
        numbers = F.when(F.octet_length(b) > 0, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(
            numbers, lambda i: F.struct((start + i * step).alias("base"), F.substring(b, (i * step + 1).cast("int"), F.lit(size)).alias("data"))
        )

    return _let(data, cut)


def with_chosen(pieces: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``chosen``, the numbers chosen by the windows of a row; ``grams``: of the whole text, ``base``: place of the first byte.

    Other columns stay; rows of ``data`` hold STRETCH + window + gram - 2 bytes, fewer at the end of a text.
    The expressions are SQL text, since building thousands of column objects takes seconds.
    """
    width, kept = STRETCH + window - 1, [f"`{c}`" for c in pieces.columns]
    left, starts = "int(grams - base) as _grams", f"int(greatest(grams - {window - 1}, least(grams, 1)) - base) as _starts"
    level = pieces.selectExpr(*kept, left, starts)
    hash_at = "if({0} < _grams, (shiftleft(crc32(substring(data, {1}, {2})), 31) | {3}L) - base, null) as _0_{0}"
    level = level.selectExpr(*kept, "_starts", *[hash_at.format(i, i + 1, gram, _PLACES - 1 - i) for i in range(width)])
    size, depth = 1, 0
    while size < window:  # the last step may overlap, so any window size will do
        steps = sorted({min(size * j, window - size) for j in range(FAN)})
        width -= steps[-1]
        least = [f"least({', '.join(f'_{depth}_{i + s}' for s in steps)}) as _{depth + 1}_{i}" for i in range(width)]
        level = level.selectExpr(*kept, "_starts", *least)
        size, depth = size + steps[-1], depth + 1
    # windows start at the places up to grams - window; a text with fewer hashes is one window
    minima = ", ".join(f"if({i} < _starts, _{depth}_{i}, null)" for i in range(STRETCH))
    # array_except drops the nulls and repeats; a lambda function here would take all of this out of compiled code
    return level.selectExpr(*kept, f"array_except(array({minima}), array(cast(null as bigint))) as chosen")


def _grams(size: Column, gram: int) -> Column:
    """How many hashes a text has: shorter texts than a k-gram have one, empty ones none."""
    return F.when(size == 0, 0).otherwise(F.greatest(size - gram + 1, F.lit(1))).cast("bigint")


def _winnowed(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str], gram: int, window: int) -> DataFrame:
    """Per row (keys are unique): the carried columns, and for each text column the chosen numbers, under its name."""
    # stretches of a text only, so that long texts are not copied into every row of them
    overlap = window + gram - 2
    segment = max(SEGMENT // STRETCH, 1) * STRETCH

    def cut_text(i: int, t: str) -> Column:
        grams = _grams(F.octet_length(t), gram)
        segments = _cut(F.col(t).cast("binary"), F.lit(0).cast("bigint"), segment, segment + overlap)
        return F.transform(segments, lambda s: F.struct(F.lit(i).alias("kind"), s["base"].alias("base"), s["data"].alias("data"), grams.alias("grams")))

    parts = [cut_text(i, t) for i, t in enumerate(texts)]
    head = F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("base"), F.lit(b"").alias("data"), F.lit(0).cast("bigint").alias("grams"))
    exploded = rows.select(*keys, *carried, F.explode(F.concat(F.array(head), *parts)).alias("s"))
    # the carried columns go with the first row of a text
    first = F.when(F.col("s.kind") == -1, F.struct(F.lit(0).alias("_"), *carried))
    segments = exploded.select(*keys, first.alias("_carried"), "s.kind", F.col("s.base").alias("_from"), "s.data", "s.grams")
    # a segment's own windows start in its first ``segment`` bytes; what follows is overlap
    cut = _cut(F.col("data"), F.col("_from"), STRETCH, STRETCH + overlap)
    own = F.filter(cut, lambda p: (p["base"] < F.col("_from") + segment) & (p["base"] < F.greatest(F.col("grams") - window + 1, F.lit(1))))
    pieces = segments.select(*keys, "_carried", "kind", "grams", F.explode_outer(own).alias("p")).select(
        *keys, "_carried", "kind", "grams", F.coalesce("p.base", F.lit(0)).alias("base"), "p.data"
    )
    chosen = with_chosen(pieces, gram, window)
    lists = [F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == i, F.col("chosen"))))).alias(t) for i, t in enumerate(texts)]
    # at least one carried struct a group; max takes the one that is not null
    return chosen.groupBy(*keys).agg(F.max("_carried").alias("_carried"), *lists).select(*keys, *[F.col(f"_carried.{c}") for c in carried], *texts)


def hashes(chosen: Column) -> Column:
    """The distinct hashes among chosen numbers."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31)))


def marks(chosen: Column) -> Column:
    """Chosen numbers as (position, hash), in the order of their positions."""
    return F.array_sort(
        F.transform(
            chosen, lambda x: F.struct((_PLACES - 1 - x.bitwiseAND(F.lit(_PLACES - 1))).alias("position"), F.shiftright(x, 31).alias("hash"))
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two lists; 1 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def _identity(key: str, text: str) -> list[Column]:
    """128 bits that stand for key and text."""
    return [F.xxhash64(key, text).alias("_h1"), F.xxhash64(text, key, F.lit(1)).alias("_h2")]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row: key, n_chars, and fingerprint, the chosen (position, hash) pairs by position; positions count bytes from 0.

    Null counts as empty; an empty text has no pair, one shorter than ``gram`` bytes one. Rows with equal
    key and text are computed once and returned as often as they occur. No rows give no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(*_identity("_key", "_text"), "_key", "_text")
    keys = ["_h1", "_h2"]
    once = rows.groupBy(*keys).agg(F.min("_key").alias("_key"), F.min("_text").alias("_text"), F.count("*").alias("_copies"))
    once = once.withColumn("_n", F.char_length("_text").cast("bigint"))
    found = _repeated(_winnowed(once, keys, ["_text"], ["_key", "_copies", "_n"], gram, window))
    return found.select(F.col("_key").alias(key), F.col("_n").alias("n_chars"), marks(F.col("_text")).alias("fingerprint"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Every row ``_copies`` times, in two steps that each make short lists only."""
    many = F.floor((F.col("_copies") - 1) / _REPEAT)
    out = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), many)))
    here = F.least(F.col("_copies") - F.col("_part") * _REPEAT, F.lit(_REPEAT))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), here))).drop("_part", "_copy", "_copies")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every text beside the next one, and beside an edit of itself that ends with the start of the next one.

    The next text is that of the next larger key (null keys last, equal keys in the order of a hash of the
    text), after the last one the first. In the edit, the last n div 2 of the text's n code points are
    replaced by as many of the next text, or all it has. Columns: key, n_chars, edited, fingerprint and
    edited_fingerprint (as in :func:`fingerprints`), near_edited and near_next (shares of common hashes).

    Null counts as empty. Rows with equal key and text are one document: they are computed once and
    returned as often as they occur. A single document is its own next one. No rows give no rows.
    """
    keys = ["_h1", "_h2"]
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(*_identity("_key", "_text"), "_key", "_text")
    size = F.char_length("_text").cast("bigint")
    ids = rows.groupBy(*keys).agg(F.min("_key").alias("_key"), F.min(size).alias("_n"), F.count("*").alias("_copies"))
    # keys and sizes only: texts are not sorted
    placed = global_position(ids, [F.col("_key").asc_nulls_last(), F.col("_h1"), F.col("_h2")], "_place")
    total = placed.count()
    if total == 0:
        placed = placed.where(F.lit(False))
    before = placed.select(
        F.pmod(F.col("_place") + 1, F.lit(max(total, 1))).alias("_place"),
        F.col("_h1").alias("_to1"),
        F.col("_h2").alias("_to2"),
        F.floor(F.col("_n") / 2).cast("int").alias("_need"),
    )
    wanted = placed.select(*keys, "_place").join(before, "_place").drop("_place")

    texts = rows.groupBy(*keys).agg(F.min("_text").alias("_text"))
    giving = texts.join(wanted, keys).withColumn("_head", F.left("_text", F.col("_need")))
    given = _winnowed(giving, keys, ["_text"], ["_to1", "_to2", "_head"], gram, window).select(
        F.col("_to1").alias("_h1"), F.col("_to2").alias("_h2"), "_head", hashes(F.col("_text")).alias("_next")
    )
    about = placed.select(*keys, "_key", "_n", "_copies")
    both = texts.join(about, keys).join(given, keys)
    kept = F.left("_text", (F.col("_n") - F.floor(F.col("_n") / 2)).cast("int"))
    both = both.withColumn("_edited", F.concat(kept, F.col("_head"))).withColumn("_edit", F.col("_edited"))
    found = _winnowed(both, keys, ["_text", "_edited"], ["_key", "_n", "_copies", "_edit", "_next"], gram, window)
    found = found.withColumn("_own", hashes(F.col("_text")))
    rated = found.select(
        F.col("_key"),
        F.col("_n"),
        F.col("_copies"),
        F.col("_edit"),
        marks(F.col("_text")).alias("_text"),
        marks(F.col("_edited")).alias("_edited"),
        likeness(F.col("_own"), hashes(F.col("_edited"))).alias("_near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("_near_next"),
    )
    out = ["key", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    named = zip(["_key", "_n", "_edit", "_text", "_edited", "_near_edited", "_near_next"], [key, *out[1:]], strict=True)
    return _repeated(rated).select(*[F.col(a).alias(b) for a, b in named])
