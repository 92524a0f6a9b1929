"""Scores over array columns: token entropy, kernel-density mode, label-word softmax, cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")

# Fixed value: ridge added to the diagonal of a Gram matrix
RIDGE = 0.001

# Fixed values of the selection rule
GRID_POINTS = 500
GRID_MARGIN = 0.5
MIN_SPREAD = 1e-6
DEFAULT_BANDWIDTH = 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Columns that may come from a Python function go in through ``value`` (several of them as a struct),
    since a Python function cannot be evaluated inside a lambda. The other way round, give the result of
    such a struct to a Python function only as a column of its own: Spark 4.1 does not plan the call when
    a nested lambda that uses the outer variable stands in its argument.
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def is_valid_score(score: Column) -> Column:
    """Neither missing, NaN nor +inf; -inf passes, as in ``score != inf``."""
    return score.isNotNull() & ~F.isnan(score) & (score != F.lit(INF))


def ordering_score(score: Column) -> Column:
    """Invalid scores rank last."""
    return F.when(is_valid_score(score), score).otherwise(F.lit(INF))


# -- token entropy ------------------------------------------------------------------------------


def top_entropy(logits: Column, top_k: int | None = None) -> Column:
    """Entropy of the softmax over the ``top_k`` largest logits of one token.

    With d = x - max, z = sum(exp d): H = ln z - sum(d * exp d) / z. A probability that underflows to
    zero makes the sum of -p * ln p hold 0 * ln 0, hence NaN.
    """
    logits = logits.cast("array<double>")
    top = logits if top_k is None else F.slice(F.sort_array(logits, asc=False), 1, top_k)

    def entropy(top: Column, most: Column) -> Column:
        sums = F.aggregate(
            top,
            F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("w")),
            lambda acc, x: F.struct(
                (acc["z"] + F.exp(x - most)).alias("z"),
                (acc["w"] + F.exp(x - most) * (x - most)).alias("w"),
            ),
        )
        least = F.exp(F.array_min(top) - most)
        return let(
            sums,
            lambda s: F.when(least / s["z"] == 0, F.lit(NAN)).otherwise(F.ln(s["z"]) - s["w"] / s["z"]),
        )

    return F.when(F.size(logits) > 0, let(top, lambda t: let(F.array_max(t), lambda most: entropy(t, most))))


def _rows_2d(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and 2-D block for each list length that occurs in an Arrow list column."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        block = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, block.astype(np.float64, copy=False).reshape(len(at), width)


def _entropies(column: pa.Array, top_k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Entropy of each list of logits, by a partial selection instead of a full sort, and where there is none."""
    out = np.full(len(column), np.nan)
    missing = np.ones(len(column), dtype=bool)
    for at, block in _rows_2d(column):
        width = block.shape[1]
        if width == 0:
            continue
        if top_k is not None and top_k < width:
            block = np.partition(block, width - top_k, axis=1)[:, width - top_k :]
        d = block - block.max(axis=1, keepdims=True)
        e = np.exp(d)
        z = e.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            h = np.log(z) - (d * e).sum(axis=1) / z
        h[(e / z[:, None]).min(axis=1) == 0] = np.nan
        out[at] = h
        missing[at] = False
    return out, missing


def top_entropy_arrow(logits: Column, top_k: int | None = None) -> Column:
    """Same as :func:`top_entropy` for wide vocabularies."""

    @F.arrow_udf("double")
    def entropy(column: pa.Array) -> pa.Array:
        out, missing = _entropies(column, top_k)
        return pa.array(out, mask=missing)

    return entropy(logits)


def mean_token_entropy_arrow(tokens: Column, top_k: int | None = None) -> Column:
    """Same as :func:`mean_token_entropy`, in Arrow batches."""

    @F.arrow_udf("double")
    def mean(column: pa.Array) -> pa.Array:
        counts = np.asarray(column.value_lengths().fill_null(0))
        flat = column.flatten()
        values, missing = _entropies(flat, top_k)
        first = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        out, none = np.full(len(column), np.nan), np.asarray(column.is_null())
        if len(some):
            widths = np.asarray(flat.value_lengths().fill_null(0))[first[some]]
            if top_k is not None:
                widths = np.minimum(widths, top_k)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[some] = np.add.reduceat(values, first[some]) / (counts[some] * widths)
            # a token without logits leaves its sample without a score
            none[some] |= np.add.reduceat(missing.astype(int), first[some]) > 0
        return pa.array(out, mask=none)

    return mean(tokens)


def mean_token_entropy(tokens: Column, top_k: int | None = None) -> Column:
    """Mean over tokens and entries of the entropies of an array of logit arrays; NaN without tokens."""
    width = F.size(tokens[0]) if top_k is None else F.least(F.size(tokens[0]), F.lit(top_k))
    entropies = total(F.transform(tokens, lambda t: top_entropy(t, top_k)))
    return F.when(F.size(tokens) > 0, entropies / (F.size(tokens) * width)).when(tokens.isNotNull(), F.lit(NAN))


# -- log-determinant and attention --------------------------------------------------------------


def safe_log(x: Column) -> Column:
    """Logarithm with log 0 = -inf instead of null."""
    return F.when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def mean_log_singular_value(z: np.ndarray) -> np.ndarray:
    """Mean log singular value of the ridged Gram matrix of centred token vectors, for a stack of samples.

    The matrix is positive definite, so this is its log-determinant over the number of tokens. With
    more tokens than features the smaller matrix is used: det(ZZ' + aI_t) = a^(t-d) det(Z'Z + aI_d).
    """
    tokens, features = z.shape[-2:]
    z = z - z.mean(axis=-1, keepdims=True)
    turned = z.swapaxes(-1, -2)
    gram = z @ turned if tokens <= features else turned @ z
    size = min(tokens, features)
    logdet = np.linalg.slogdet(gram + RIDGE * np.eye(size))[1] + (tokens - size) * np.log(RIDGE)
    return logdet / tokens


def log_det_score(vectors: Column) -> Column:
    """:func:`mean_log_singular_value` of each row's array of token vectors; NaN without tokens.

    A null in place of a vector is a token that is missing.
    """

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        rows = pc.list_parent_indices(column).to_numpy()
        lengths = np.bincount(rows[np.asarray(column.flatten().is_valid())], minlength=len(column))
        out = np.full(len(column), np.nan)
        for tokens in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == tokens)
            # the second flatten leaves the nulls out
            flat = column.take(pa.array(at)).flatten().flatten().to_numpy(zero_copy_only=False)
            out[at] = mean_log_singular_value(flat.astype(np.float64, copy=False).reshape(len(at), tokens, -1))
        return pa.array(out, mask=np.asarray(column.is_null()))

    return scores(vectors)


def self_attention_score(heads: Column) -> Column:
    """Sum over heads of the mean log self-attention; one array of token values per head, null where a token is missing."""

    def head_mean(values: Column) -> Column:
        known = F.filter(values, lambda x: x.isNotNull())
        logs = total(F.transform(known, lambda x: safe_log(x.cast("double"))))
        return F.when(F.size(known) > 0, logs / F.size(known)).otherwise(F.lit(NAN))

    return total(F.transform(heads, head_mean))


# -- kernel-density mode ------------------------------------------------------------------------


def bandwidth(spread: Column, count: Column) -> Column:
    """Rule-of-thumb bandwidth from the population standard deviation, with two lower bounds."""
    rule = F.pow(4 * F.pow(spread, 5.0) / (3 * count), 0.2)
    raw = F.when(spread > MIN_SPREAD, rule).otherwise(DEFAULT_BANDWIDTH)
    return F.when(raw < MIN_SPREAD, DEFAULT_BANDWIDTH).otherwise(raw)


def grid_point(k: Column, low: Column, high: Column, spread: Column) -> Column:
    """Point k of the search grid, which reaches half a deviation beyond the scores."""
    start = low - GRID_MARGIN * spread
    stop = high + GRID_MARGIN * spread
    return start + k * (stop - start) / (GRID_POINTS - 1)


def kernel(distance: Column) -> Column:
    return F.exp(-0.5 * distance * distance)


def density_mode(scores: Column) -> Column:
    """Grid point of highest density of the valid scores, the first on ties.

    Null when fewer than two scores are valid or one of them is infinite; callers then take the
    lowest score.
    """
    valid = F.filter(scores.cast("array<double>"), is_valid_score)

    def moments(v: Column) -> Column:
        mean = total(v) / F.size(v)
        return let(
            mean,
            lambda m: F.struct(
                F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)).alias("sd"),
                F.array_min(v).alias("low"),
                F.array_max(v).alias("high"),
            ),
        )

    def mode(v: Column, s: Column) -> Column:
        def peak(bw: Column) -> Column:
            points = F.transform(
                F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)),
                lambda k: grid_point(k, s["low"], s["high"], s["sd"]),
            )

            def density(x: Column) -> Column:
                return F.aggregate(v, F.lit(0.0), lambda acc, y: acc + kernel((x - y) / bw))

            def first_highest(xs: Column, d: Column) -> Column:
                return F.element_at(xs, F.array_position(d, F.array_max(d)).cast("int"))

            return let(points, lambda xs: let(F.transform(xs, density), lambda d: first_highest(xs, d)))

        return let(bandwidth(s["sd"], F.size(v)), peak)

    return let(
        valid,
        lambda v: F.when(
            (F.size(v) > 1) & ~F.exists(v, lambda x: x == F.lit(-INF)),
            let(moments(v), lambda s: mode(v, s)),
        ),
    )


def density_mode_arrow(scores: Column) -> Column:
    """Same as :func:`density_mode`, evaluated for a whole Arrow batch at a time.

    Marked nondeterministic only to keep filters from being moved below it, which would evaluate it twice.
    """

    @F.arrow_udf("double")
    def modes(column: pa.Array) -> pa.Array:
        out = np.full(len(column), np.nan)
        for at, block in _rows_2d(column):
            usable = ~np.isnan(block) & (block != np.inf)
            counts = usable.sum(axis=1)
            for count in np.unique(counts[counts > 1]):
                rows = np.flatnonzero(counts == count)
                v = block[rows][usable[rows]].reshape(len(rows), count)
                out[at[rows]] = _batch_modes(v)
        return pa.array(out, mask=np.isnan(out))

    return modes.asNondeterministic()(F.transform(scores.cast("array<double>"), lambda x: F.coalesce(x, F.lit(INF))))


# Rows evaluated together: their 500 densities fit in a processor cache
_BLOCK = 128


def _batch_modes(v: np.ndarray) -> np.ndarray:
    """Density mode of each row; NaN for rows that hold -inf."""
    finite = np.isfinite(v).all(axis=1)
    v = np.where(finite[:, None], v, 0.0)
    sd = v.std(axis=1)
    bw = np.where(sd > MIN_SPREAD, (4 * sd**5 / (3 * v.shape[1])) ** 0.2, DEFAULT_BANDWIDTH)
    bw = np.where(bw < MIN_SPREAD, DEFAULT_BANDWIDTH, bw)
    start = v.min(axis=1) - GRID_MARGIN * sd
    width = v.max(axis=1) + GRID_MARGIN * sd - start
    peaks = np.empty(len(v))
    for at in range(0, len(v), _BLOCK):
        rows = slice(at, at + _BLOCK)
        grid = start[rows, None] + np.arange(GRID_POINTS) * width[rows, None] / (GRID_POINTS - 1)
        density = np.zeros_like(grid)
        for j in range(v.shape[1]):
            u = (grid - v[rows, j : j + 1]) / bw[rows, None]
            density += np.exp(-0.5 * u * u)
        peaks[rows] = grid[np.arange(len(grid)), density.argmax(axis=1)]
    return np.where(finite, peaks, np.nan)


# -- vectors ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))


def softmax(values: Column) -> Column:
    """Softmax of an array of doubles, shifted by the maximum."""

    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most)))

    return let(values, lambda v: normalised(shifted(v)))


def normalised(values: Column) -> Column:
    """Array of doubles divided by its total."""
    return let(values, lambda v: let(total(v), lambda z: F.transform(v, lambda x: x / z)))
